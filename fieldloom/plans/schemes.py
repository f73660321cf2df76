"""Scheme tables: which discretisation each differential operator gets.

An entry for an operator and its fields comes first, then the section's
default, then the solver's, then the first of the catalogue; a section
whose default is "none", or a strict table, wants every key spelled out.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from ..errors import ConfigError, warn_once
from ..mesh import Mesh
from ..operators import stencils
from ..sources.config import parse
from .expr import Expr, key_of, transformed

#: Families with their schemes; the first is the default. Fixed names.
CATALOGUE = {
    "ddt": ("EULER", "RK4"),
    "laplacian": ("CD2", "CD4", "CD6", "Iso9", "Iso27"),
    "gradient": ("CD2", "CD4", "CD6", "Iso9"),
    "gradSq": ("CD2", "Iso9"),
    "advection": ("UW1", "UW2", "WENO5"),
    "anisoDiv": ("CD2", "Iso9"),
    "interpolation": ("LinearGhost", "Nearest"),
    "snGrad": ("CD2",),
    "faceGrad": ("CD2",),
    "fluxDiv": ("CD2",),
    "secondDerivative": ("CD2", "CD4", "CD6"),
    "divGrad": ("CD2", "Iso9"),
    "divNormal": ("CD2", "Iso21", "Iso21Vector"),
}
PRESETS = {
    "AxialCD2": {"laplacian": "CD2", "gradient": "CD2", "gradSq": "CD2", "divGrad": "CD2", "divNormal": "CD2"},
    "Ji2022S21": {"laplacian": "Iso9", "gradient": "Iso9", "gradSq": "Iso9", "divGrad": "Iso9", "divNormal": "Iso21"},
}
_FAMILY = {"lap": "laplacian", "grad_sq": "gradSq", "advect": "advection", "div_grad": "divGrad", "div_normal": "divNormal"}
_CALL = {"laplacian": "lap", "gradient": "grad", "gradSq": "gradSq", "advection": "adv", "secondDerivative": "d2", "divGrad": "divGrad", "divNormal": "divNormal"}


@dataclass
class Schemes:
    """sections: {family: {"default": name, "op(field)": name}}."""

    sections: dict[str, dict[str, str]] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    strict: bool = False
    used: set[tuple[str, str]] = field(default_factory=set)

    def __post_init__(self) -> None:
        for family, entries in self.sections.items():
            if family not in CATALOGUE:
                raise ConfigError("schemes", f"unknown section {family}", f"one of {sorted(CATALOGUE)}")
            for key, name in entries.items():
                if name not in CATALOGUE[family] and not (key == "default" and name == "none"):
                    raise ConfigError("schemes", f"unknown {family} scheme {name} for {key}", f"one of {CATALOGUE[family]}")

    @classmethod
    def preset(cls, name: str, overrides: dict[str, dict[str, str]] | None = None) -> Schemes:
        if name not in PRESETS:
            raise ConfigError("schemes", f"unknown preset {name}", f"one of {sorted(PRESETS)}")
        sections = {family: {"default": scheme} for family, scheme in PRESETS[name].items()}
        for family, entries in (overrides or {}).items():
            sections.setdefault(family, {}).update(entries)
        return cls(sections)

    @classmethod
    def from_config(cls, config: dict, defaults: dict[str, str] | None = None) -> Schemes:
        config = dict(config)
        return cls({k: v for k, v in config.items() if isinstance(v, dict)}, defaults or {}, config.get("policy") == "strict")

    @classmethod
    def beside(cls, settings: str, defaults: dict[str, str] | None = None) -> Schemes:
        """schemes.jsonc in the folder of a settings file; without it the solver's defaults."""
        path = Path(settings).with_name("schemes.jsonc")
        if not path.exists():
            warn_once(f"schemes {path}", f"no {path}: the solver's defaults are used")
            return cls({}, defaults or {})
        return cls.from_config(parse(path.read_text(encoding="utf-8")).value, defaults)

    def resolve(self, family: str, operand: str) -> str:
        """The scheme of a family for an operand such as "phi", "phi,x" or "u,phi"."""
        entries, call = self.sections.get(family, {}), _CALL.get(family, family)
        keys = [f"{call}({operand})"]
        if family == "gradient" and "," in operand:
            keys.append(f"{call}({operand.split(',')[0]})")
        if family == "advection" and not self.strict:
            keys.append(f"{call}({operand.split(',')[-1]})")
        for key in keys:
            if key in entries:
                self.used.add((family, key))
                return entries[key]
        if self.strict or entries.get("default") == "none":
            raise ConfigError("schemes", f"{family} needs an entry for {keys[0]}")
        return entries.get("default") or self.defaults.get(family) or CATALOGUE[family][0]

    def unused(self) -> list[str]:
        """Entries that nothing asked for; each is warned about once."""
        out = sorted(f"{f}:{k}" for f, e in self.sections.items() for k in e if k != "default" and (f, k) not in self.used)
        for key in out:
            warn_once(f"scheme {key}", f"scheme entry {key} is not used")
        return out

    def bind(self, e: Expr, mesh: Mesh) -> Expr:
        """Replace differential operators by their schemes, innermost first."""

        def bound(n: Expr) -> Expr | None:
            if n.op not in _FAMILY and n.op != "d":
                return None
            key = key_of(n)
            args = tuple(self.bind(a, mesh) for a in n.args)
            if n.op == "d":
                if len(n.payload) == 1:
                    return stencils.first(args[0], n.payload[0], mesh, self.resolve("gradient", key))
                scheme = self.resolve("secondDerivative", key)
                a, b = n.payload
                return stencils.second(args[0], a, mesh, scheme) if a == b else stencils.mixed(args[0], (a, b), mesh, scheme)
            scheme = self.resolve(_FAMILY[n.op], key)
            if n.op == "lap":
                return stencils.laplacian(args[0], mesh, scheme)
            if n.op == "grad_sq":
                return stencils.grad_squared(args[0], mesh, scheme)
            if n.op == "advect":
                return stencils.advection(args[:-1], args[-1], mesh, scheme)
            if n.op == "div_grad":
                return stencils.div_grad(*args, mesh, scheme)
            return stencils.div_normal(*args, mesh, scheme, n.payload)

        return transformed(e, bound)


def template(operators: list[str]) -> str:
    """An editable scheme file with an entry for every operator that needs one."""
    out: dict[str, dict[str, str]] = {}
    for op in operators:
        name, operand = op.split("(", 1)
        operand = operand[:-1]
        family = _FAMILY.get(name) or ("secondDerivative" if operand.count(",") > 1 else "gradient")
        out.setdefault(family, {"default": "none"})[f"{_CALL[family]}({operand})"] = CATALOGUE[family][0]
    return json.dumps(out, indent=2, sort_keys=True)
