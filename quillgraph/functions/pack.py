"""Domain packs: types, relation types, triplets, settings, prompts and hooks read from a folder."""

from __future__ import annotations

import importlib.util
import json
import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillgraph.functions import domain


@dataclass(frozen=True)
class Pack:
    """A domain. types are full dotted names; relations give each type's weight and allowed pairs (none: any pair)."""

    name: str
    types: tuple[str, ...]
    relations: dict[str, tuple[float, tuple[tuple[str, str], ...]]]
    settings: dict[str, Any] = field(default_factory=dict)
    prompts: dict[str, str] = field(default_factory=dict)
    hooks: Any = None

    def flat_types(self) -> list[str]:
        return sorted(set(self.types))

    def relation_weights(self, spark: SparkSession) -> DataFrame:
        rows = [(k, float(w), not pairs) for k, (w, pairs) in sorted(self.relations.items())]
        return spark.createDataFrame(rows, "relation_type string, schema_weight double, any_pair boolean")

    def allowed_triplets(self, spark: SparkSession) -> DataFrame:
        rows = [(k, a, b) for k, (_, pairs) in sorted(self.relations.items()) for a, b in pairs]
        return spark.createDataFrame(rows, "relation_type string, subject string, object string")

    def type_text(self) -> str:
        """The types as a prompt lists them, one a line."""
        return "\n".join(f"- {t}" for t in self.flat_types())

    def relation_text(self) -> str:
        return "\n".join(f"- {k} (weight {w:g})" for k, (w, _) in self.relations.items())

    def triplet_text(self) -> str:
        return "\n".join(f"- {a} -{k}-> {b}" for k, (_, pairs) in self.relations.items() for a, b in (pairs or (("any", "any"),)))

    def prompt(self, name: str, **values: str) -> str:
        """A prompt with {types}, {relations}, {triplets} and the given values put in; an unknown name is an error."""
        if name not in self.prompts:
            raise ValueError(f"unknown prompt: {name}")
        out = self.prompts[name]
        for key, value in {"types": self.type_text(), "relations": self.relation_text(), "triplets": self.triplet_text(), **values}.items():
            out = out.replace("{" + key + "}", value)
        return out


def reading() -> Pack:
    """The built-in domain."""
    return Pack("reading", domain.ENTITY_TYPES, domain.RELATIONS)


def _data(folder: str, stem: str) -> dict[str, Any]:
    for suffix in (".yaml", ".yml", ".json"):
        path = os.path.join(folder, stem + suffix)
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                if suffix == ".json":
                    return json.load(f) or {}
                try:
                    import yaml
                except ImportError:
                    raise ValueError(f"{path}: no YAML reader is installed; a JSON file serves as well") from None
                return yaml.safe_load(f) or {}
    return {}


def _types(tree: Any, above: str = "") -> list[str]:
    """Full names of a type tree: a mapping of names to subtrees or lists, or a list of names or of such mappings."""
    out: list[str] = []
    if isinstance(tree, dict):
        for name, below in tree.items():
            full = f"{above}.{name}" if above else str(name)
            out.append(full)
            if isinstance(below, dict) and set(below) & {"subtypes", "description", "label"}:
                below = below.get("subtypes")
            out += _types(below, full)
    elif isinstance(tree, list):
        for item in tree:
            if isinstance(item, dict) and "name" in item:
                out += _types({item["name"]: item.get("subtypes")}, above)
            elif isinstance(item, dict):
                out += _types(item, above)
            else:
                out.append(f"{above}.{item}" if above else str(item))
    return out


def _relations(listed: Any) -> dict[str, tuple[float, tuple[tuple[str, str], ...]]]:
    rows = listed.items() if isinstance(listed, dict) else [(r["name"], r) for r in listed or []]
    out = {}
    for name, r in rows:
        r = r or {}
        pairs = [(p["subject"], p["object"]) if isinstance(p, dict) else tuple(p) for p in r.get("triplets") or ()]
        out[name] = (float(r.get("weight", 1.0)), tuple((str(a), str(b)) for a, b in pairs))
    return out


def first_hooks(module: Any) -> Any:
    """An instance of the first class of a module, by name, that offers a hook (pre_ingest, post_extract or validators)."""
    for name in dir(module):
        made = getattr(module, name)
        if isinstance(made, type) and made.__module__ == module.__name__ and any(hasattr(made, h) for h in ("pre_ingest", "post_extract", "validators")):
            return made()
    return None


_loaded: dict[str, Pack] = {}


def load(folder: str) -> Pack:
    """The pack in a folder: domain.yaml (or .json) with entity_types and relation_types, config, prompts/*.md or .txt, hooks.py.

    A folder without a domain file is an error. Hooks run code of the folder, so load only what you trust; the result is
    kept for each folder.
    """
    at = os.path.abspath(folder)
    if at in _loaded:
        return _loaded[at]
    told = _data(at, "domain")
    if not told:
        raise ValueError(f"no domain file in {folder}")
    prompts = {}
    shelf = os.path.join(at, "prompts")
    for name in sorted(os.listdir(shelf)) if os.path.isdir(shelf) else ():
        stem, suffix = os.path.splitext(name)
        if suffix in (".md", ".txt"):
            with open(os.path.join(shelf, name), encoding="utf-8") as f:
                prompts[stem] = f.read()
    hooks = None
    code = os.path.join(at, "hooks.py")
    if os.path.isfile(code):
        spec = importlib.util.spec_from_file_location(f"domain_hooks_{abs(hash(at))}", code)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        hooks = first_hooks(module)
    relations = told.get("relation_types", told.get("relations"))
    _loaded[at] = Pack(str(told.get("name", os.path.basename(at))), tuple(_types(told.get("entity_types", told.get("types")))), _relations(relations), _data(at, "config"), prompts, hooks)
    return _loaded[at]
