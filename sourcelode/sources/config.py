"""The configuration file: YAML of at most 64 KiB, checked field by field; values are never echoed."""

from __future__ import annotations

import re
from typing import Any

import yaml

from ..model import CAPS, CONFIG_FILE, LIMITS, WEIGHTS, Configuration, InputError

MAX_BYTES, MAX_DEPTH, MAX_LIST = 65_536, 16, 128
FIELDS = ("profile", "scope", "respectGitignore", "sourceExtensions", "exclude", "entryPoints", "limits", "thresholds", "duplication", "score")
CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def bad(message: str) -> InputError:
    return InputError("INVALID_CONFIG", message)


class _Loader(yaml.SafeLoader):
    """No aliases, no tags, no repeated keys, limited depth."""

    depth = 0

    def compose_node(self, parent, index):
        if self.check_event(yaml.AliasEvent):
            raise bad("YAML aliases are not allowed.")
        event = self.peek_event()
        if getattr(event, "tag", None) not in (None, "!"):
            raise bad("YAML tags are not supported.")
        self.depth += 1
        if self.depth > MAX_DEPTH + 1:
            raise bad("The configuration is nested too deeply.")
        try:
            return super().compose_node(parent, index)
        finally:
            self.depth -= 1

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        if any(not isinstance(k, str) for k in keys) or len(set(keys)) != len(keys):
            raise bad("Keys must be text and unique.")
        return super().construct_mapping(node, deep=deep)


# The core schema of YAML 1.2: no dates, no yes and no, no numbers in base 60.
_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")),
    ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+0123456789.")),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), _first)


def is_relative_path(value: Any) -> bool:
    if not isinstance(value, str) or not value or len(value) > 256 or "\\" in value or value.startswith("/"):
        return False
    return not re.match(r"(?i)[a-z]:", value) and not CONTROL.search(value) and not {".", "..", ""} & set(value.split("/"))


def is_pattern(value: Any) -> bool:
    return is_relative_path(value) and not re.search(r"[{}\[\]!()]", value) and all("**" not in p or p == "**" for p in value.split("/"))


def valid_scope(value: Any) -> list[str]:
    if not isinstance(value, list) or len(value) > MAX_LIST or not all(is_relative_path(v) and not re.search(r"[*?]", v) for v in value):
        raise bad("scope: up to 128 relative directories within the root, with / between names.")
    return sorted(set(value))


def _keys(value: Any, allowed, name: str) -> dict:
    if not isinstance(value, dict):
        raise bad(f"{name}: a map is expected.")
    if set(value) - set(allowed):
        raise bad(f"{name}: unknown field.")
    return value


def _whole(value: Any, most: int, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise bad(f"{name}: a whole number from 1 to {most} is expected.")
    return value


def parse_configuration(source: str, profile: str | None = None) -> Configuration:
    if len(source.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        raise InputError("FILE_LIMIT", f"{CONFIG_FILE} is larger than the limit.")
    try:
        value = yaml.load(source, _Loader)
    except yaml.YAMLError:
        raise bad("Invalid YAML.") from None
    value = _keys(value, FIELDS, CONFIG_FILE)
    if "profile" in value and value["profile"] not in ("standard", "large"):
        raise bad("profile: standard or large is expected.")
    config = Configuration(profile or value.get("profile", "standard"))
    if "scope" in value:
        config.scope = valid_scope(value["scope"])
    if "respectGitignore" in value:
        if not isinstance(value["respectGitignore"], bool):
            raise bad("respectGitignore: true or false is expected.")
        config.respect_gitignore = value["respectGitignore"]
    for name, fits, attribute in (
        ("sourceExtensions", lambda v: isinstance(v, str) and re.fullmatch(r"\.[a-z0-9]{1,16}", v), "source_extensions"),
        ("exclude", is_pattern, "exclude"),
        ("entryPoints", is_pattern, "entry_points"),
    ):
        if name in value:
            own = value[name]
            if not isinstance(own, list) or len(own) > MAX_LIST or not all(fits(v) for v in own):
                raise bad(f"{name}: a list of up to 128 valid entries is expected.")
            setattr(config, attribute, getattr(config, attribute) + own)
    if "limits" in value:
        for k, v in _keys(value["limits"], LIMITS, "limits").items():
            config.limits[k] = _whole(v, LIMITS[k][1], f"limits.{k}")
    for name in ("thresholds", "duplication"):
        if name in value:
            target = getattr(config, name)
            for k, v in _keys(value[name], target, name).items():
                target[k] = _whole(v, 1_000 if name == "duplication" and k != "minBytes" else 100_000, f"{name}.{k}")
    if "score" in value:
        for part, allowed, target in (("weights", WEIGHTS, config.weights), ("caps", CAPS, config.caps)):
            given = _keys(value["score"], ("weights", "caps"), "score").get(part)
            if part in value["score"]:
                for k, v in _keys(given, allowed, f"score.{part}").items():
                    if isinstance(v, bool) or not isinstance(v, int | float) or not 0 <= v <= 100:
                        raise bad(f"score.{part}: numbers from 0 to 100 are expected.")
                    target[k] = v
    for attribute in ("exclude", "entry_points", "source_extensions"):
        setattr(config, attribute, sorted(set(getattr(config, attribute))))
    return config
