"""Parameters of a forest, their resolution against a data set, and the option list."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace

#: Least difference of impurity (unnormalised) that makes a split sensible.
MIN_GAIN = 0.01
#: Trees that dropout measures want on each side.
MIN_TREES = 20


@dataclass(frozen=True)
class ForestParams:
    """User settings. criterion: entropy (any classes) or gini (two classes, per-tree feature subsets)."""

    trees: int = 100
    features: int = 0  # per node; 0: from the number of attributes
    seed: int = 1
    max_depth: int = 0  # 0: unlimited
    bag_percent: int = 100
    out_of_bag: bool = False
    criterion: str = "entropy"
    tree_features: int = 0  # gini: per tree; 0: from the number of attributes
    importances: bool = False
    dropout_importances: bool = False
    interactions: bool = False
    dropout_interactions: bool = False
    class_change: bool = True  # gini: only boundaries between rows of different classes
    ranged: bool = True  # scan columns by ranges of values in parallel; off for small tables, where one task a column is faster
    threads: int = 0  # kept for compatibility; the cluster decides

    def __post_init__(self):
        if self.criterion not in ("entropy", "gini"):
            raise ValueError("criterion must be entropy or gini")
        if self.trees < 1 or not 1 <= self.bag_percent <= 100 or self.max_depth < 0:
            raise ValueError("trees >= 1, 1 <= bag_percent <= 100 and max_depth >= 0 are needed")
        if self.out_of_bag and self.bag_percent != 100:
            raise ValueError("bag_percent must be 100 to measure the out-of-bag error")


@dataclass(frozen=True)
class ResolvedParams:
    """What holds for one fit: the user's settings are never changed."""

    params: ForestParams
    trees: int
    features: int
    tree_features: int


def resolve(params: ForestParams, attributes: int) -> ResolvedParams:
    """attributes: features plus the class. Fixed rules: the defaults of K and of the per-tree subsets."""
    a, free = attributes, max(1, attributes - 1)
    k = min(params.features, free)
    if params.criterion == "entropy":
        return ResolvedParams(params, params.trees, k if k >= 1 else min(free, int(math.log2(a)) + 1), free)
    if k < 1:
        k = int(math.log2(a)) + 5
    trees, subset = params.trees, params.tree_features or int(a**0.6) + 60
    if subset >= a:
        subset, k = free, int(math.log2(a)) + 1
    if params.dropout_importances:
        trees = max(trees, 2 * MIN_TREES)
        subset = min((trees - MIN_TREES) * a // trees, max(MIN_TREES * a // trees + 1, subset))
    if params.dropout_interactions:
        trees = max(trees, 2 * MIN_TREES)
        subset = (trees // 2) * a // trees + 1
    subset = min(max(1, subset), free)
    return ResolvedParams(params, trees, min(k, subset), subset)


_OPTIONS = {
    "-I": "trees",
    "-K": "features",
    "-S": "seed",
    "-depth": "max_depth",
    "-threads": "threads",
    "-P": "bag_percent",
    "-numFeatTree": "tree_features",
}
_FLAGS = {"-O": "out_of_bag", "-import": "importances", "-importNew": "dropout_importances", "-interactions": "interactions", "-interactionsNew": "dropout_interactions"}

#: Flags that turn off what is on by default.
_OFF = {"-noClassChange": "class_change", "-noRanges": "ranged"}


def from_options(options: list[str], base: ForestParams | None = None) -> ForestParams:
    """Parse an option list; without -I it means 10 trees."""
    found: dict = {"trees": 10}
    rest = list(options)
    while rest:
        name = rest.pop(0)
        if name in _FLAGS:
            found[_FLAGS[name]] = True
        elif name in _OPTIONS and rest:
            found[_OPTIONS[name]] = int(rest.pop(0))
        elif name in _OFF:
            found[_OFF[name]] = False
        elif name == "-criterion" and rest:
            found["criterion"] = rest.pop(0)
        else:
            raise ValueError(f"unknown option {name}")
    return replace(base or ForestParams(), **found)


def to_options(params: ForestParams) -> list[str]:
    """The option list that from_options reads back."""
    default = {f.name: f.default for f in fields(ForestParams)}
    out = ["-I", str(params.trees)]
    for option, name in _OPTIONS.items():
        if name != "trees" and getattr(params, name) != default[name]:
            out += [option, str(getattr(params, name))]
    out += [option for option, name in _FLAGS.items() if getattr(params, name)]
    out += [option for option, name in _OFF.items() if not getattr(params, name)]
    return out + (["-criterion", params.criterion] if params.criterion != default["criterion"] else [])
