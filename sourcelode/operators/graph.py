"""Reachability, strongly connected components and the shortest closed path of each."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def reachable(edges: DataFrame, seeds: DataFrame, source: str = "from_file", target: str = "to_file", hops: int = 3, max_rounds: int = 10_000) -> DataFrame:
    """Nodes reached from seeds(node), seeds too. Each round takes the last round's new nodes alone some hops
    along the edges and drops what is known by an anti-join; rounds are the longest shortest path by hops."""
    links = written(edges.select(F.col(source).alias("_a"), F.col(target).alias("node")).distinct(), "edges")
    known = written(seeds.select("node").distinct(), "reached")
    fresh, all_ = known, [known]
    for _ in range(max_rounds):
        step = hop = fresh
        for _ in range(hops):
            hop = hop.withColumnRenamed("node", "_a").join(links, "_a").select("node").distinct()
            step = step.unionByName(hop)
        step = step.distinct()
        known = all_[0]
        for more in all_[1:]:
            known = known.unionByName(more)
        fresh = written(step.join(known, "node", "left_anti"), "reached")
        if not fresh.take(1):
            break
        all_.append(fresh)
        if len(all_) > 16:
            all_ = [written(known.unionByName(fresh), "reached")]
    out = all_[0]
    for more in all_[1:]:
        out = out.unionByName(more)
    return out


def closure(edges: DataFrame, source: str = "from_file", target: str = "to_file") -> DataFrame:
    """(a, b) for every path of one edge or more, by doubling. The result is quadratic in a component: for small
    graphs and for tests; components of large ones come from strong_components."""
    now = written(edges.select(F.col(source).alias("a"), F.col(target).alias("b")).distinct(), "closure")
    count = now.count()
    while True:
        twice = now.alias("x").join(now.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
        now = written(now.unionByName(twice).distinct(), "closure")
        last, count = count, now.count()
        if last == count:
            return now


def _components(adjacency: dict[str, list]) -> list[list[str]]:
    """Tarjan's algorithm without recursion."""
    index, low, on_stack, stack, out, counter = {}, {}, set(), [], [], 0
    for root in adjacency:
        if root in index:
            continue
        work = [(root, iter(adjacency[root]))]
        index[root] = low[root] = counter
        counter += 1
        stack.append(root)
        on_stack.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = counter
                    counter += 1
                    stack.append(nxt)
                    on_stack.add(nxt)
                    work.append((nxt, iter(adjacency[nxt])))
                    break
                if nxt in on_stack:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        x = stack.pop()
                        on_stack.discard(x)
                        members.append(x)
                        if x == node:
                            break
                    out.append(members)
    return out


def _graph(pdf: pd.DataFrame) -> tuple[dict[str, list], dict[str, list[tuple]]]:
    rows = pdf.sort_values(["from_file", "to_file", "line", "column"])
    adjacency: dict[str, list] = {}
    outgoing: dict[str, list[tuple]] = {}
    for a, b, line, column in zip(rows["from_file"], rows["to_file"], rows["line"], rows["column"], strict=True):
        adjacency.setdefault(a, []).append(b)
        adjacency.setdefault(b, [])
        outgoing.setdefault(a, []).append((b, int(line), int(column)))
    return adjacency, outgoing


def _closed_path(start: str, members: set[str], outgoing: dict[str, list[tuple]]) -> list[tuple]:
    """The first edge of `start` inside the component, and the shortest way back, edges in (target, line, column) order."""
    first = next(e for e in outgoing[start] if e[0] in members)
    path = [(start, *first)]
    if first[0] == start:
        return path
    parent: dict[str, tuple] = {first[0]: ()}
    queue = deque([first[0]])
    while queue and start not in parent:
        node = queue.popleft()
        for target, line, column in outgoing.get(node, []):
            if target in members and target not in parent:
                parent[target] = (node, target, line, column)
                queue.append(target)
    back, node = [], start
    while node != first[0]:
        back.append(parent[node])
        node = parent[node][0]
    return path + back[::-1]


EDGES = "array<struct<from_file:string,to_file:string,line:int,column:int>>"


def strong_components(edges: DataFrame, group: str = "repo_id") -> DataFrame:
    """edges(group, from_file, to_file, line, column) -> group, start, size, members, path: components of more
    than one node or with a loop. A group is one repository's graph, bounded by maxDependencies; groups are
    dealt with side by side."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        adjacency, outgoing = _graph(pdf)
        rows = []
        for members in _components(adjacency):
            if len(members) > 1 or members[0] in adjacency[members[0]]:
                members = sorted(members)
                path = _closed_path(members[0], set(members), outgoing)
                edges_ = [{"from_file": a, "to_file": b, "line": line, "column": column} for a, b, line, column in path]
                rows.append((pdf[group].iloc[0], members[0], len(members), members, edges_))
        return pd.DataFrame(rows, columns=[group, "start", "size", "members", "path"])

    kind = dict(edges.dtypes)[group]
    own = edges.select(group, "from_file", "to_file", F.col("line").cast("int"), F.col("column").cast("int"))
    return own.groupBy(group).applyInPandas(run, f"{group} {kind}, start string, size int, members array<string>, path {EDGES}")


def capped_components(components: DataFrame, limit: int, group: str = "repo_id") -> DataFrame:
    """The first `limit` components of a group by smallest member, and whether there were more."""
    order = Window.partitionBy(group).orderBy("start")
    every = Window.partitionBy(group)
    ranked = components.withColumn("_n", F.row_number().over(order)).withColumn("truncated", F.count(F.lit(1)).over(every) > limit)
    return ranked.filter(F.col("_n") <= limit).drop("_n")


def file_usage(files: DataFrame, reached: DataFrame, has_entries: bool, uncertain: bool) -> DataFrame:
    """files(path) -> file, state, confidence, reason."""
    known = reached.select(F.col("node").alias("path")).distinct().withColumn("_hit", F.lit(True))
    joined = files.select("path").join(known, "path", "left")
    hit, none = F.col("_hit").isNotNull(), F.lit(not has_entries)
    return joined.select(
        F.col("path").alias("file"),
        F.when(hit, "reachable").when(none, "unknown").otherwise("candidate").alias("state"),
        F.when(hit, "CONFIRMED").when(none, "UNKNOWN").otherwise("SUSPICIOUS" if uncertain else "LIKELY").alias("confidence"),
        F.when(hit, "A known entry point leads here, type references included.")
        .when(none, "There is no known entry point; a lack of references proves nothing.")
        .otherwise(
            "Nothing static leads here; references that cannot be determined might."
            if uncertain
            else "No path of the static graph leads here from a known entry point."
        )
        .alias("reason"),
    )


def shortest_cycles(edges: DataFrame, max_length: int, group: str = "repo_id") -> DataFrame:
    """node, length of its shortest closed path up to max_length: breadth-first within each component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        adjacency, _ = _graph(pdf)
        rows = []
        for members in _components(adjacency):
            own = set(members)
            for node in members:
                seen, queue = set(), deque([(node, 0)])
                while queue:
                    at, n = queue.popleft()
                    if n >= max_length:
                        break
                    if node in adjacency[at]:
                        rows.append((node, n + 1))
                        break
                    for nxt in adjacency[at]:
                        if nxt in own and nxt not in seen:
                            seen.add(nxt)
                            queue.append((nxt, n + 1))
        return pd.DataFrame(rows, columns=["node", "length"])

    own = edges.select(group, "from_file", "to_file", F.col("line").cast("int"), F.col("column").cast("int"))
    return own.groupBy(group).applyInPandas(run, "node string, length int")
