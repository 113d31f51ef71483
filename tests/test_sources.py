"""Trees, configurations, manifests and the parser: plain Python, one small tree a case."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sourcelode.functions.redaction import safe_text
from sourcelode.functions.text import glob_regex
from sourcelode.model import CONFIG_FILE, IGNORE_FILE, Configuration, InputError
from sourcelode.sources import manifest, tree
from sourcelode.sources.config import parse_configuration
from sourcelode.sources.parse_ts import count_lines, parse
from sourcelode.sources.tsconfig import TSConfig, configurations, strip_jsonc


def make(root, files):
    for path, text in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


def refs(source, file="a.ts"):
    return [(d["specifier"], d["kind"], d["syntax"]) for d in parse(file, source).dependencies]


# --- parser ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("import a, { b, type C } from './b.js'", [("./b.js", "runtime", "import"), ("./b.js", "type-only", "import")]),
        ("import { type A, type B } from 'x'", [("x", "type-only", "import")]),
        ("import type D from 'd'", [("d", "type-only", "import")]),
        ("import 'side'", [("side", "runtime", "import")]),
        ("export * from './x'; export * as n from './y'", [("./x", "runtime", "re-export"), ("./y", "runtime", "re-export")]),
        ("export type { T } from './t'", [("./t", "type-only", "re-export")]),
        ("import fs = require('fs')", [("fs", "runtime", "require")]),
        ("import type z = require('z')", [("z", "type-only", "require")]),
        ("type X = import('./types').Foo", [("./types", "type-only", "import-type")]),
        ("const x = await import(`./lazy`)", [("./lazy", "runtime", "dynamic-import")]),
        ("import(variable); require(variable)", [(None, "runtime", "dynamic-import"), (None, "runtime", "require")]),
        ("function f(require) {} require('a')", [(None, "runtime", "require")]),
        ("const { require } = m; require('a')", [(None, "runtime", "require")]),
        ("require = 1; require('a')", [(None, "runtime", "require")]),
        ("module.require('a')", [(None, "runtime", "dynamic-import")]),
        ("declare module 'm' { export * from './inner' }\nimport './outer'", [("./inner", "type-only", "re-export"), ("./outer", "runtime", "import")]),
        ("const s = \"import './no'\"; // require('no')\n/* import 'no' */", []),
        ("const t = `a ${require('in')} b`", [("in", "runtime", "require")]),
    ],
)
def test_references(source, expected):
    assert refs(source) == expected


@pytest.mark.parametrize("source", ["export const = 1", "f(1", "const a = ;", "'open", "`open", "/* open", "}", "(]"])
def test_syntax_errors(source):
    found = parse("a.ts", source)
    assert not found.valid and [d["code"] for d in found.diagnostics] == ["SYNTAX_ERROR"] and not found.dependencies


def test_functions():
    source = """function foo(a: number): { x: string } {
  return a / 2 / 1;
}
const bar = async (x) => {
  return /[/"]}/.test(x);
};
class K { constructor() { } get v() { return 1; } static async m<T>(x: T): Promise<T> { return x } abs(): void; }
const o = { p: function () { return 1; }, q() { if (x) { y(); } } };
declare function ambient(): void;
"""
    found = parse("a.ts", source).functions
    assert [(f["name"], f["line"], f["end_line"]) for f in found] == [
        ("foo", 1, 3), ("bar", 4, 6), ("constructor", 7, 7), ("v", 7, 7), ("m", 7, 7), ("(anonymous/computed)", 8, 8), ("q", 8, 8)
    ]


def test_equal_bodies_have_equal_tokens():
    found = parse("a.ts", "function a() { return 1 + 2; }\nfunction b() { /* note */ return 1 +\n 2; }\nfunction c() { return 1 + 3; }")
    bodies = [[t["hash"] for t in found.tokens[a:b]] for a, b in found.blocks[1:]]
    assert bodies[0] == bodies[1] != bodies[2]


def test_elements():
    source = "const A = () => <div a=\"x\">it's {items.map(i => <B key={i}/>)} text</div>;\nconst g = <T,>(x: T) => x;"
    found = parse("a.tsx", source)
    assert found.valid and [f["name"] for f in found.functions] == ["A", "(anonymous/computed)", "g"]


def test_columns_are_utf16_units():
    assert parse("a.ts", "'🎉'; require('x')").dependencies[0]["column"] == 7


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r", "\u2028", "\u2029"])
def test_line_ends(end):
    text = end.join("abcd")
    assert count_lines(text) == count_lines(text + end) == 4 and count_lines("") == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n(){}[]<>`'\"/\\*$=;:,.abimport require=>0"), max_size=40))
def test_parser_never_crashes(source):
    try:
        parse("a.tsx", source)
    except RecursionError:
        pytest.fail("recursion")


def test_generated_and_limits():
    assert parse("a.ts", "// @generated\nimport './x'").generated
    assert [d["code"] for d in parse("a.ts", "a;b;c", {"maxAstNodes": 2}).diagnostics] == ["AST_LIMIT"]
    assert [d["code"] for d in parse("a.ts", "import 'a';import 'b'", {"maxDependencies": 1}).diagnostics] == ["DEPENDENCY_LIMIT"]
    assert [d["code"] for d in parse("a.ts", "a;b;c", {"maxDuplicationTokens": 2}).diagnostics] == ["DUPLICATION_TOKEN_LIMIT"]
    assert [d["code"] for d in parse("a.ts", "/// <reference path='x' />").diagnostics] == ["UNSUPPORTED_REFERENCE"]


# --- trees -------------------------------------------------------------------------------------------------


def test_ignore_layers(tmp_path):
    root = make(tmp_path, {
        ".gitignore": "cache/*\n!cache/keep.ts\n*.log.ts\n", IGNORE_FILE: "secret.ts\n", "nested/.gitignore": "!allowed.log.ts\nlocal.ts\n",
        "cache/keep.ts": "", "cache/drop.ts": "", "index.ts": "", "secret.ts": "", "x.log.ts": "", "nested/allowed.log.ts": "", "nested/local.ts": "",
    })
    assert tree.discover(root, Configuration()).files == ["cache/keep.ts", "index.ts", "nested/allowed.log.ts"]


def test_exclusion_links_and_languages(tmp_path):
    root = make(tmp_path, {"a.ts": "", "a.d.ts": "", "node_modules/x.ts": "", "sub/dist/y.ts": "", "README": "", "x.nim": "", "q.PY": "", "BUILD": "", ".ts": ""})
    os.symlink(tmp_path / "a.ts", tmp_path / "link.ts")
    found = tree.discover(root, Configuration(source_extensions=[".nim"]))
    assert found.files == ["BUILD", "a.ts", "q.PY", "x.nim"] and [d["code"] for d in found.diagnostics] == ["LINK_SKIPPED"]


@pytest.mark.parametrize(("limit", "code"), [("maxFiles", "FILE_COUNT_LIMIT"), ("maxEntries", "ENTRY_LIMIT")])
def test_limits_of_the_walk(tmp_path, limit, code):
    root = make(tmp_path, {f"{c}.ts": "" for c in "abc"})
    assert code in [d["code"] for d in tree.discover(root, Configuration(limits={limit: 1})).diagnostics]


def test_depth_and_scope(tmp_path):
    root = make(tmp_path, {"a/b/c/d.ts": "", "e/f.ts": "", "package.json": "{}"})
    assert "DEPTH_LIMIT" in [d["code"] for d in tree.discover(root, Configuration(limits={"maxDepth": 1})).diagnostics]
    found = tree.discover(root, Configuration(scope=["a/b", "none"]))
    assert found.files == ["a/b/c/d.ts"] and found.manifests == ["package.json"] and [d["code"] for d in found.diagnostics] == ["EMPTY_SCOPE"]


def test_safe_reads(tmp_path):
    root = make(tmp_path, {"a.ts": "ok", "bad.ts": b"\xff\xfe", "big.ts": "x" * 100})
    os.symlink("/etc", tmp_path / "out")
    assert tree.safe_read(root, "a.ts", 10) == "ok"
    for path, code in (("bad.ts", "READ_ERROR"), ("big.ts", "FILE_LIMIT"), ("../x", "ROOT_ESCAPE"), ("out/passwd", "LINK_SKIPPED")):
        with pytest.raises(InputError) as error:
            tree.safe_read(root, path, 10)
        assert error.value.code == code
    with pytest.raises(InputError) as error:
        tree.safe_read(root, "a.ts", 10, tree.Budget(1))
    assert error.value.code == "TOTAL_BYTES_LIMIT" and tree.is_inside("/a/b", "/a/b/c") and not tree.is_inside("/a/b", "/a/bc")


# --- configuration -----------------------------------------------------------------------------------------


def test_configuration():
    config = parse_configuration("profile: large\nscope: [b, a]\nexclude: ['custom/**']\nlimits: {maxFiles: 5}\nthresholds: {fileLines: 7}\nscore: {weights: {oversized-file: 1.5}, caps: {size: 0}}\nentryPoints: [src/*.ts]\nrespectGitignore: false\nsourceExtensions: [.nim]")
    assert config.scope == ["a", "b"] and "custom/**" in config.exclude and config.limits["maxFiles"] == 5 and config.limits["maxDepth"] == 128
    assert config.thresholds["fileLines"] == 7 and config.weights["oversized-file"] == 1.5 and config.caps["size"] == 0 and not config.respect_gitignore


@pytest.mark.parametrize(
    "source",
    ["[]", "a: 1", "profile: huge", "scope: ['../x']", "scope: ['a*']", "exclude: ['/a']", "exclude: ['a**']", "limits: {maxFiles: 0}", "limits: {x: 1}", "limits: {maxFiles: 1.5}",
     "thresholds: {fileLines: true}", "score: {weights: {oversized-file: -1}}", "score: {caps: []}", "entryPoints: ['a/../b']", "sourceExtensions: [nim]", "a: &x 1\nb: *x", "scope: !!python/tuple []",
     "profile: large\nprofile: large", "respectGitignore: yes", "scope: {a: [[[[[[[[[[[[[[[[[[1]]]]]]]]]]]]]]]]]]}", "duplication: {minTokens: 1001}", "x: ["],
)
def test_invalid_configurations(source):
    with pytest.raises(InputError) as error:
        parse_configuration(source)
    assert error.value.code == "INVALID_CONFIG"


def test_configuration_that_is_too_large():
    with pytest.raises(InputError) as error:
        parse_configuration(" " * 65_537)
    assert error.value.code == "FILE_LIMIT" and CONFIG_FILE in error.value.message


# --- TypeScript configurations -----------------------------------------------------------------------------


def load(files, path="tsconfig.json"):
    notes = []

    def read(name):
        if name not in files:
            raise FileNotFoundError(name)
        return files[name]

    return configurations([path], read, Configuration(), lambda code, *_: notes.append(code))[0], notes


def test_tsconfig_extends_and_aliases():
    files = {"tsconfig.json": '{ // note\n "extends": "./base", "compilerOptions": {"baseUrl": "src",}, }', "base.json": '{"compilerOptions": {"paths": {"@lib/*": ["lib/*"], "exact": ["one.ts"], "@lib/deep/*": ["deep/*"]}, "outDir": "dist", "rootDir": "src"}}'}
    config, notes = load(files)
    assert not notes and config.base == "src" and config.out_dir == "dist"
    assert {p: t for p, t, _ in config.aliases} == {"@lib/*": ["src/lib/*"], "exact": ["src/one.ts"], "@lib/deep/*": ["src/deep/*"]}


@pytest.mark.parametrize("text", ['"strict": "yes"', '"unknownOption": true', '"target": "es1999"', '"lib": "es2020"', '"types": [1]', '"outDir": 3', '"paths": []', '"help": true'])
def test_compiler_options_are_checked(text):
    config, notes = load({"tsconfig.json": '{"compilerOptions": {%s}}' % text})
    assert set(notes) == {"INVALID_TSCONFIG"} and not config.supported


def test_known_compiler_options_pass():
    text = '"strict": true, "target": "ES2022", "module": "NodeNext", "lib": ["es2022", "dom"], "jsx": "react-jsx", "maxNodeModuleJsDepth": 2, "plugins": [{}], "baseUrl": ".", "declaration": null'
    config, notes = load({"tsconfig.json": '{"compilerOptions": {%s}}' % text})
    assert not notes and config.supported and config.base == ""


def test_a_parent_is_read_once_and_its_state_shared():
    files, reads, notes = {"a/tsconfig.json": '{"extends": "../base"}', "b/tsconfig.json": '{"extends": "../base.json"}', "base.json": '{"extends": "./gone", "compilerOptions": {"baseUrl": "lib"}}'}, [], []

    def read(name):
        reads.append(name)
        return files[name] if name in files else (_ for _ in ()).throw(FileNotFoundError(name))

    a, b = configurations(["a/tsconfig.json", "b/tsconfig.json"], read, Configuration(), lambda code, *_: notes.append(code))
    assert reads == ["a/tsconfig.json", "base.json", "gone.json", "b/tsconfig.json"] and notes == ["READ_ERROR"]
    assert (a.base, b.base, a.supported, b.supported, a.directory, b.directory) == ("lib", "lib", False, False, "a", "b")


@pytest.mark.parametrize(
    ("text", "code"),
    [("[]", "INVALID_TSCONFIG"), ("{", "INVALID_TSCONFIG"), ('{"extends": "pkg"}', "UNSUPPORTED_TSCONFIG"), ('{"extends": "../../x"}', "ROOT_ESCAPE"), ('{"extends": "./tsconfig.json"}', "TSCONFIG_LIMIT"),
     ('{"compilerOptions": {"baseUrl": "../.."}}', "INVALID_TSCONFIG"), ('{"compilerOptions": {"paths": {"a*b*": ["x"]}}}', "INVALID_TSCONFIG"), ('{"compilerOptions": {"rootDirs": []}}', "UNSUPPORTED_TSCONFIG"), ('{"__proto__": 1}', "INVALID_TSCONFIG")],
)
def test_rejected_tsconfigs(text, code):
    config, notes = load({"tsconfig.json": text})
    assert notes == [code] and not config.supported


def test_comments_in_strings_stay():
    assert strip_jsonc('{"a": "// no /* x */", /* y */ "b": [1,], // z\n}').replace(" ", "").replace("\n", "") == '{"a":"//no/*x*/","b":[1]}'
    assert TSConfig("").aliases == []


# --- manifests ---------------------------------------------------------------------------------------------


def script(text, name="build", declared=("tool", "typescript", "@s/cli")):
    return manifest.script_facts(name, text, set(declared))


@pytest.mark.parametrize(
    ("text", "entries", "tools"),
    [
        ("node server.js", [("server.js", True)], []),
        ("tsc && tool run", [], ["typescript", "tool"]),
        ("npx @s/cli x", [], ["@s/cli"]),
        ("node --import ./pre.mjs --test a.test.js b.test.js", [("./pre.mjs", True), ("a.test.js", True), ("b.test.js", True)], []),
        ("NODE_ENV=x tool src/a.ts", [("src/a.ts", False)], ["tool"]),
        ("node -r tool main.js", [("main.js", True)], ["tool"]),
        ("echo a.js", [], []),
        ("npm run build; pnpm exec tool", [], ["tool"]),
        ("node --conditions dev 'my file.js'", [("my file.js", True)], []),
        ("node main.js --import=./late.mjs args.js", [("main.js", True), ("./late.mjs", True)], []),
        ("yarn run tool.js; yarn tool", [("tool.js", False)], ["tool"]),
        ("cross-env A=1 npx tsx src/run.ts | cat out.js", [("src/run.ts", True)], []),
        ('node "a \\" b.js" && echo \'x\\\' y\'', [('a " b.js', True)], []),
    ],
)
def test_scripts(text, entries, tools):
    facts = script(text)
    assert [e[:2] for e in facts.entries] == entries and facts.tools == tools and not facts.uncertain


@pytest.mark.parametrize("text", ["node $(which x) a.js", "node -e 'x'", "cd sub && node a.js", "node \"a.js", "NODE_OPTIONS=-r x node a.js", "node -p1"])
def test_uncertain_scripts(text):
    assert script(text).uncertain


def test_purposes():
    assert [script("node a.js", n).entries[0][2] for n in ("start", "dev:web", "test:unit", "e2e", "lint")] == ["application", "application", "test", "test", "tooling"]


def test_manifest():
    found = manifest.parse_manifest("p/package.json", '{"main": "a.js", "exports": {".": {"import": ["./b.mjs", null]}, "./x": "./style.css"}, "bin": "../../out.js", "dependencies": {"a": "1", "B!": "1"}, "peerDependencies": {"a": "2"}, "scripts": {"x": 1}}')
    assert sorted(found.targets) == ["./b.mjs", "a.js"] and found.packages == {"a": ["dependencies", "peerDependencies"]} and len(found.problems) == 3
    assert manifest.parse_manifest("package.json", "{").problems and manifest.parse_manifest("package.json", "[]").problems


@pytest.mark.parametrize(("specifier", "name"), [("a/b", "a"), ("@s/p/q", "@s/p"), ("./x", None), ("/x", None), ("#x", None), ("node:fs", None), ("", None), ("@s", "@s"[:0] or None)])
def test_package_of(specifier, name):
    assert manifest.package_of(specifier) == name


# --- globs and redaction -----------------------------------------------------------------------------------


def segments_match(path, pattern):
    """By the definition: '**' is any number of segments, '*' and '?' stay within one."""
    import fnmatch
    import re

    def go(p, g):
        if not g:
            return not p
        if g[0] == "**":
            return go(p, g[1:]) or bool(p) and go(p[1:], g)
        if not p:
            return False
        one = re.escape(g[0]).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        return bool(re.fullmatch(one, p[0])) and go(p[1:], g[1:])

    del fnmatch
    return go(path.split("/"), pattern.split("/"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", ""]), min_size=1, max_size=4), st.lists(st.sampled_from(["**", "*", "a", "a*", "?b", "?"]), min_size=1, max_size=4))
def test_glob_equals_its_definition(path, pattern):
    import re

    path, pattern = "/".join(path), "/".join(pattern)
    assert bool(re.match(glob_regex(pattern), f"{path}/")) == segments_match(path, pattern)


def test_redaction():
    key, long_id = "ghp_" + "a1" * 10, "x1" * 20
    text = f'{key} {long_id} https://u:p@host Bearer abc.def password = "my \\" secret" token: xyz \u202e\x07'
    safe = safe_text(text)
    for secret in (key, long_id, "u:p", "abc.def", 'secret"', "xyz", "\u202e", "\x07"):
        assert secret not in safe
    assert "[U+202e][U+0007]" in safe and safe_text(safe) == safe and safe_text("plain words") == "plain words"


@pytest.mark.parametrize("text", [
    "const a = 1 2;", "return return", "import {a b} from 'x'", "if else", "var 1x = 2", "const x: number = = 3", "foo bar;", "a = b c", "x = 'a' 'b'",
    "let y = 3 z", "while x {}", "const 5 = 1", "a && || b", "if x) {", "f(1 2)", "[a b]", "call('x' y)", "const s = 0x1G", "a ?? = b",
])
def test_invalid_statements(text):
    parsed = parse("a.ts", f"import './b';\n{text}\n")
    assert not parsed.valid and parsed.dependencies == [] and [d["code"] for d in parsed.diagnostics] == ["SYNTAX_ERROR"] and parsed.diagnostics[0]["line"] >= 2


@pytest.mark.parametrize("text", [
    "async function* f() { for await (const x of y) yield x; }", "type A = B extends infer U ? U : keyof typeof x;", "abstract class A<T extends B> extends C implements D, E { declare readonly a: string; static async *b() {} get c() { return 1 } set c(v) {} }",
    "function isA(x: unknown): x is string { return typeof x === 'string' }", "function f(x): asserts x is T {}", "export default abstract class {}", "export as namespace Foo;", "import type { A } from 'a';", "import def, * as ns from 'b'",
    "import json from './x.json' with { type: 'json' };", "declare module 'x' { export const a: 1 }", "declare global { interface Window { a: 1 } }", "label: while (true) { continue label }", "if (a) b(); else c();", "do x(); while (y)",
    "const x = a as const, y = <T>b satisfies C;", "@Input() name: string;", "class A { @Input name: string; @a.b c = 1 }", "const f = async x => await x;", "x = a in b, y = a instanceof B;", "for (const k in o) if (k) break;", "let v = void 0, w = delete a.b, z = new A;",
    "a\nb", "return\nreturn", "const o = { if: 1, while: 2, get: 3, async: 4, default: 5, get x() { return 1 }, async 'y'() {}, static: 1 };", "o.if = o.return; o?.while", "switch (x) { case 'a': case 1: return 2; default: throw new Error('x') }",
    "const enum E { A = 1, B = A << 2 }", "type F = new (...a: any[]) => T; type G = abstract new () => T;", "let u: unique symbol; let r: readonly string[] = [];", "interface A { readonly a: 1; new (x: 1): A; (y: 2): B }", "namespace A.B { }", "import x = require('y');",
    "function f(this: Window, ...args) {}", "const g = function* () { yield* h(); };", "x ||= 1; y ??= 2; z **= 3;", "const t = `a ${b} c` + tag`d`;", "type T1 = 1 extends 2 ? 'a' : 'b';", "let n = 1_000n, m = .5e-3, h = 0xFF, k = 1..toString();", "accessor;", "var type = 1, of = 2, as = 3; type = of;",
    "class A<in out T, const U> {}", "using a = b;", "export { a as default, type B } from './x';", "export * as ns from 'y';", "let a: Array<Map<string, number>>= [];", "const f = <T,>(x: T) => x;", "if (a) return b\nelse return c", "try { a() } catch { b() } finally { c() }", "x = y ? -1 : +2", "enum A { B = 'x' }", "export = foo;", "let f: (a: 1) => void = () => {};",
])
def test_valid_statements(text):
    parsed = parse("a.ts", text)
    assert parsed.valid, parsed.diagnostics


def test_trees_in_stores_that_spark_reads(spark, tmp_path):
    """The table of files of a tree, without a walk on the driver: no NUL, valid UTF-8 only."""
    for path, data in {"src/a.ts": b"export {};", "b.py": "ä = 1\n".encode(), "bad.ts": b"\xff\xfe", "nul.ts": b"a\0b"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(data)
    files = tree.read_tree_files(spark, str(tmp_path), str(tmp_path), "repo").collect()
    assert sorted((r["repo_id"], r["path"], r["content"], r["bytes"]) for r in files) == [("repo", "b.py", "ä = 1\n", 7), ("repo", "src/a.ts", "export {};", 10)]
