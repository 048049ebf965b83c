"""The annotated matrix: a sparse cell-by-gene matrix with tables on both axes.

Matrices are long tables (cell, gene, value) whose missing entries are zero. A frame is
immutable: every operation returns a new one, and nothing runs until an action.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANNEL_TYPES = ("X", "raw_X", "obs", "var", "obsm", "varm", "obsp", "varp", "layers", "uns")


@dataclasses.dataclass(frozen=True)
class AnnotatedFrame:
    """x: (cell, gene, value); obs: (cell, ...); var: (gene, ...); other channels by name."""

    x: DataFrame
    obs: DataFrame
    var: DataFrame
    layers: Mapping[str, DataFrame] = dataclasses.field(default_factory=dict)
    obsm: Mapping[str, DataFrame] = dataclasses.field(default_factory=dict)
    varm: Mapping[str, DataFrame] = dataclasses.field(default_factory=dict)
    obsp: Mapping[str, DataFrame] = dataclasses.field(default_factory=dict)
    varp: Mapping[str, DataFrame] = dataclasses.field(default_factory=dict)
    uns: Mapping[str, Any] = dataclasses.field(default_factory=dict)
    raw: DataFrame | None = None
    splits: DataFrame | None = None
    config: Mapping[str, Any] = dataclasses.field(default_factory=dict)
    mod: Mapping[str, "AnnotatedFrame"] = dataclasses.field(default_factory=dict)

    def replace(self, **changes: Any) -> "AnnotatedFrame":
        return dataclasses.replace(self, **changes)

    def put(self, channel_type: str, name: str, value: Any) -> "AnnotatedFrame":
        """A frame with one more named channel."""
        return self.replace(**{channel_type: {**getattr(self, channel_type), name: value}})

    @property
    def num_cells(self) -> int:
        return self.obs.count()

    @property
    def num_genes(self) -> int:
        return self.var.count()

    # Selection ---------------------------------------------------------------

    def keep_cells(self, cells: DataFrame) -> "AnnotatedFrame":
        """Only the cells of a table (cell); splits keep what is left of them."""
        cells = cells.select("cell").distinct()
        on = lambda df: df.join(cells, "cell", "left_semi")
        ends = lambda df: df.join(cells.withColumnRenamed("cell", "src"), "src", "left_semi").join(cells.withColumnRenamed("cell", "dst"), "dst", "left_semi")
        return self.replace(
            x=on(self.x), obs=on(self.obs), raw=None if self.raw is None else on(self.raw), splits=None if self.splits is None else on(self.splits),
            layers={k: on(v) for k, v in self.layers.items()}, obsm={k: on(v) for k, v in self.obsm.items()}, obsp={k: ends(v) for k, v in self.obsp.items()},
        )

    def keep_genes(self, genes: DataFrame) -> "AnnotatedFrame":
        """Only the genes of a table (gene)."""
        genes = genes.select("gene").distinct()
        on = lambda df: df.join(genes, "gene", "left_semi")
        return self.replace(x=on(self.x), var=on(self.var), layers={k: on(v) for k, v in self.layers.items()}, varm={k: on(v) for k, v in self.varm.items()})

    def filter_by_mask(self, mask: Column) -> "AnnotatedFrame":
        """The cells for which a condition on obs holds."""
        return self.keep_cells(self.obs.where(mask))

    # Splits ------------------------------------------------------------------

    def with_split_ranges(self, ranges: Mapping[str, tuple[int, int]], order: str = "cell") -> "AnnotatedFrame":
        """Splits by positions [start, end) in the order of a column; they may overlap."""
        for span in ranges.values():
            if not isinstance(span, tuple) or len(span) != 2 or not all(isinstance(v, int) for v in span):
                raise TypeError(f"a split range is a pair of integers, not {span!r}")
        from .operators.ordering import with_position

        at = with_position(self.obs.select("cell", *([order] if order != "cell" else [])), order)
        parts = [at.where((F.col("position") >= s) & (F.col("position") < e)).select(F.lit(k).alias("split"), "cell") for k, (s, e) in ranges.items() if e > s]
        if not parts:
            return self
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return self.replace(splits=out)

    def with_split_sizes(self, train: int | str, val: int = 0, test: int = -1) -> "AnnotatedFrame":
        """Contiguous train, val and test splits; one size may be -1, the remainder."""
        return self.with_split_ranges(split_ranges(self.num_cells, train, val, test))

    def split_cells(self, name: str | None, error_on_miss: bool = False) -> DataFrame | None:
        """The cells of a split; all for None; None (or KeyError) for an unknown one."""
        if name is None:
            return self.obs.select("cell")
        found = None if self.splits is None else self.splits.where(F.col("split") == name).select("cell")
        if found is None or not found.take(1):
            if error_on_miss:
                raise KeyError(f"unknown split {name!r}")
            return None
        return found

    def split(self, name: str) -> "AnnotatedFrame":
        return self.keep_cells(self.split_cells(name, error_on_miss=True))

    def pop(self, name: str) -> "AnnotatedFrame":
        """The frame without the cells of a split."""
        gone = self.split_cells(name, error_on_miss=True)
        left = self.keep_cells(self.obs.join(gone, "cell", "left_anti"))
        return left.replace(splits=left.splits.where(F.col("split") != name))

    def append(self, other: "AnnotatedFrame", mode: str | None = "merge", rename: Mapping[str, str] | None = None, new_split: str | None = None, label_batch: bool = False, batch: str = "batch") -> "AnnotatedFrame":
        """Cells of another frame below these; genes are the union; layers and embeddings of one name are united.

        mode: merge joins splits of one name, rename gives every split of the other a new
        name, new_split puts all its cells into one split, None adds none. New names must
        not be in use here. label_batch: number the batches on in a column of obs. Cell
        keys must differ.
        """
        names = lambda f: set() if f.splits is None else {r.split for r in f.splits.select("split").distinct().collect()}
        if mode == "merge":
            added = other.splits
        elif mode == "rename":
            if rename is None:
                raise ValueError("mode rename needs the new names")
            if used := names(self) & set(rename.values()):
                raise ValueError(f"new names are in use: {sorted(used)}")
            if missing := names(other) - set(rename):
                raise KeyError(f"no new name for {sorted(missing)}")
            added = other.splits
            if added is not None and rename:
                to = F.create_map(*(F.lit(v) for pair in rename.items() for v in pair))
                added = added.withColumn("split", to[F.col("split")])
        elif mode == "new_split":
            if new_split is None:
                raise ValueError("mode new_split needs a name")
            if not isinstance(new_split, str):
                raise TypeError(f"a split's name is a string, not {new_split!r}")
            if new_split in names(self):
                raise ValueError(f"the name {new_split!r} is in use")
            added = other.obs.select(F.lit(new_split).alias("split"), "cell")
        elif mode is None:
            added = None
        else:
            raise ValueError(f"unknown mode {mode!r}")
        mine, theirs = self.obs, other.obs
        if label_batch:
            mine = mine if batch in mine.columns else mine.withColumn(batch, F.lit(0))
            last = mine.agg(F.max(batch)).first()[0] or 0
            theirs = theirs.drop(batch).withColumn(batch, F.lit(last + 1))
        parts = [s for s in (self.splits, added) if s is not None]
        both = lambda a, b: {k: a[k].unionByName(b[k], allowMissingColumns=True) if k in a and k in b else a.get(k, b.get(k)) for k in {**a, **b}}
        return self.replace(
            x=self.x.unionByName(other.x), obs=mine.unionByName(theirs, allowMissingColumns=True),
            var=self.var.unionByName(other.var.join(self.var.select("gene"), "gene", "left_anti"), allowMissingColumns=True),
            splits=None if not parts else parts[0] if len(parts) == 1 else parts[0].select("split", "cell").unionByName(parts[1].select("split", "cell")),
            layers=both(self.layers, other.layers), obsm=both(self.obsm, other.obsm), uns={**other.uns, **self.uns},
        )

    # The query ---------------------------------------------------------------

    def set_config(self, overwrite: bool = False, **options: Any) -> "AnnotatedFrame":
        """feature_/label_ mod, channel and channel_type: what get_x and get_y give."""
        known = {f"{a}_{b}" for a in ("feature", "label") for b in ("mod", "channel", "channel_type")}
        for key, value in options.items():
            if key not in known:
                raise KeyError(f"unknown option {key!r}")
            if not overwrite and self.config.get(key, value) != value:
                raise KeyError(f"{key} is {self.config[key]!r}; overwrite=True changes it")
        for side in ("feature", "label"):
            sizes = {len(v) for k, v in options.items() if k.startswith(side) and isinstance(v, (list, tuple))}
            if len(sizes) > 1:
                raise ValueError(f"lists of {side} options differ in length")
        return self.replace(config={**self.config, **options})

    def get_feature(self, split: str | None = None, channel: str | None = None, channel_type: str | None = None, mod: str | None = None) -> Any:
        """A channel, with only the split's cells; gene channels and uns come whole."""
        frame = self.mod[mod] if mod else self
        kind = channel_type or ("obsm" if channel else "X")
        if kind not in CHANNEL_TYPES:
            raise ValueError(f"unknown channel type {kind!r}")
        if kind in ("X", "raw_X"):
            value = frame.x if kind == "X" else frame.raw
        elif kind in ("obs", "var"):
            value = getattr(frame, kind)
            value = value.select("cell" if kind == "obs" else "gene", channel) if channel else value
        else:
            value = getattr(frame, kind)[channel]
        if split is None or kind in ("var", "varm", "varp", "uns"):
            return value
        cells = self.split_cells(split, error_on_miss=True)
        if kind == "obsp":
            return value.join(cells.withColumnRenamed("cell", "src"), "src", "left_semi").join(cells.withColumnRenamed("cell", "dst"), "dst", "left_semi")
        return value.join(cells, "cell", "left_semi")

    def _get(self, side: str, split: str | None) -> Any:
        options = [self.config.get(f"{side}_{k}") for k in ("channel", "channel_type", "mod")]
        try:
            if any(isinstance(o, (list, tuple)) for o in options):
                n = max(len(o) for o in options if isinstance(o, (list, tuple)))
                wide = [o if isinstance(o, (list, tuple)) else [o] * n for o in options]
                return [self.get_feature(split, *o) for o in zip(*wide)]
            return self.get_feature(split, *options)
        except Exception as error:
            raise RuntimeError(f"no {side} for split {split!r} with {dict(self.config)}") from error

    def get_x(self, split: str | None = None) -> Any:
        return self._get("feature", split)

    def get_y(self, split: str | None = None) -> Any:
        return self._get("label", split)

    def get_data(self, split: str | None = None) -> tuple[Any, Any]:
        return self.get_x(split), self.get_y(split)


def split_ranges(n: int, train: int | str, val: int = 0, test: int = -1) -> dict[str, tuple[int, int]]:
    """Positions of contiguous train, val and test splits; empty ones are left out."""
    if train == "all":
        return {"train": (0, n)}
    sizes = [train, val, test]
    if not all(isinstance(s, int) for s in sizes):
        raise TypeError("split sizes are integers, or train is 'all'")
    if sizes.count(-1) > 1:
        raise ValueError("only one split can be the remainder")
    if any(s < -1 or s > n for s in sizes) or sum(max(s, 0) for s in sizes) > n:
        raise ValueError(f"splits {sizes} do not fit {n} cells")
    rest = n - sum(s for s in sizes if s > 0)
    at, out = 0, {}
    for name, s in zip(("train", "val", "test"), sizes):
        size = rest if s == -1 else s
        if size:
            out[name] = (at, at + size)
        at += size
    return out


def common_genes(frames: Iterable[AnnotatedFrame]) -> DataFrame:
    """Genes that all frames have."""
    first, *rest = frames
    out = first.var.select("gene")
    for f in rest:
        out = out.join(f.var.select("gene"), "gene", "left_semi")
    return out


