"""Named, reviewed analyses: a registry with checked parameters and composable findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from planline.errors import Refusal


@dataclass(frozen=True)
class Param:
    """A parameter: ``kind`` text, number or flag, and its default (None: required)."""

    name: str
    kind: str = "text"
    default: object = None

    def coerce(self, value: object) -> object:
        try:
            if self.kind == "number":
                return float(value)
            if self.kind == "flag":
                return {"true": True, "false": False}[str(value).lower()]
        except (TypeError, ValueError, KeyError):
            raise Refusal("bad_parameter", f"{self.name}={value!r} is no {self.kind}") from None
        if value == "":
            raise Refusal("empty_filter", f"{self.name} is empty")
        return str(value)


@dataclass(frozen=True)
class Recipe:
    """``run(entities, **params)`` gives rows; ``finding`` names the column of handles if the rows are a finding."""

    name: str
    run: Callable[..., DataFrame]
    params: tuple[Param, ...] = ()
    finding: str | None = None
    says: str = ""


@dataclass
class Registry:
    recipes: dict[str, Recipe] = field(default_factory=dict)

    def register(self, recipe: Recipe) -> None:
        if recipe.name in self.recipes:
            raise Refusal("duplicate_recipe", recipe.name)
        self.recipes[recipe.name] = recipe

    def catalog(self) -> list[dict]:
        return [{"name": r.name, "says": r.says, "params": [p.name for p in r.params], "composable": r.finding is not None} for _, r in sorted(self.recipes.items())]

    def bind(self, name: str, params: dict) -> tuple[Recipe, dict]:
        recipe = self.recipes.get(name)
        if recipe is None:
            raise Refusal("unknown_recipe", name, "one of " + ", ".join(sorted(self.recipes)))
        known = {p.name: p for p in recipe.params}
        if extra := sorted(set(params) - set(known)):
            raise Refusal("unknown_parameter", ", ".join(extra), "one of " + ", ".join(known))
        bound = {}
        for p in recipe.params:
            if p.name in params:
                bound[p.name] = p.coerce(params[p.name])
            elif p.default is None:
                raise Refusal("missing_parameter", p.name)
            else:
                bound[p.name] = p.default
        return recipe, bound

    def run(self, name: str, entities: DataFrame, **params: object) -> DataFrame:
        recipe, bound = self.bind(name, params)
        return recipe.run(entities, **bound)

    def combine(self, entities: DataFrame, left: tuple[str, dict], right: tuple[str, dict], operation: str) -> DataFrame:
        """intersect, union or difference of two findings' handles; a recipe without a finding is refused."""
        sides = []
        for name, params in (left, right):
            recipe, bound = self.bind(name, params)
            if recipe.finding is None:
                raise Refusal("not_composable", name, "its rows are no set of objects")
            sides.append(recipe.run(entities, **bound).select(recipe.finding).toDF("handle"))
        a, b = sides
        operations = {"intersect": a.intersect, "union": lambda o: a.union(o).distinct(), "difference": a.subtract}
        if operation not in operations:
            raise Refusal("unknown_operation", operation, "intersect, union or difference")
        return operations[operation](b)


def default_registry() -> Registry:
    """The recipes over parcel rows (handle, layer, area, ring and box columns)."""
    from pyspark.sql import functions as F

    from planline.operators import aggregates, spatial, windows

    registry = Registry()
    registry.register(
        Recipe(
            "outliers",
            lambda df, field, z: windows.outliers(df, ["layer"], field, z),
            (Param("field", "text", "area"), Param("z", "number", 3.0)),
            "handle",
            "Objects further than z deviations from their layer's mean.",
        )
    )
    registry.register(
        Recipe(
            "parcel_inventory",
            lambda df, min_area, max_area: aggregates.measure(df.where(F.col("area").between(min_area, max_area)), ["layer"], "area"),
            (Param("min_area", "number", 0.0), Param("max_area", "number", 1e12)),
            None,
            "Parcels and their area by layer, within a band of sizes.",
        )
    )
    registry.register(
        Recipe(
            "overlap_scan",
            lambda df, min_overlap: spatial.ring_overlap_area(
                spatial.box_pairs(df.select("handle", "minx", "miny", "maxx", "maxy", "ring", "area"), 40.0)
            ).where(F.col("overlap") > min_overlap),
            (Param("min_overlap", "number", 1e-6),),
            "a_handle",
            "Pairs of rings that share area.",
        )
    )
    registry.register(
        Recipe("size_module", lambda df, top: df.groupBy("w", "h").count().orderBy(F.desc("count"), "w", "h").limit(int(top)), (Param("top", "number", 10.0),), None, "The commonest sizes.")
    )
    return registry
