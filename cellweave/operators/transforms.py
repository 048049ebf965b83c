"""Registered transforms: frame in, frame out, parameters by keyword.

Each has the scope that a pipeline refers to. Data-dependent sizes (cells, genes) are
counts of the annotation tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import AnnotatedFrame
from ..registry import register
from . import features, filters, graphs, normalize, ordering, sampling, selection, spatial, stats

P = "preprocessor"


def _bounds(frame: AnnotatedFrame, axis: str, split: str | None, channel: str | None, kw: dict) -> DataFrame:
    x = frame.layers[channel] if channel else frame.x
    if split:
        x = x.join(frame.split_cells(split, error_on_miss=True), "cell", "left_semi")
    names, other = (frame.var, frame.num_cells) if axis == "gene" else (frame.obs, frame.num_genes)
    return filters.by_thresholds(x, axis, names, n_other=other, **kw)


@register(f"{P}.filter.cell", "FilterCellsScanpy")
def filter_cells(frame: AnnotatedFrame, min_counts=None, max_counts=None, min_genes=None, max_genes=None, channel=None) -> AnnotatedFrame:
    return frame.keep_cells(_bounds(frame, "cell", None, channel, dict(min_counts=min_counts, max_counts=max_counts, min_entries=min_genes, max_entries=max_genes)))


@register(f"{P}.filter.gene", "FilterGenesScanpy")
def filter_genes(frame: AnnotatedFrame, min_counts=None, max_counts=None, min_cells=None, max_cells=None, split_name=None, channel=None) -> AnnotatedFrame:
    return frame.keep_genes(_bounds(frame, "gene", split_name, channel, dict(min_counts=min_counts, max_counts=max_counts, min_entries=min_cells, max_entries=max_cells)))


def _ordered(frame: AnnotatedFrame, axis: str, order: Sequence[str], kw: dict) -> DataFrame:
    other = {"gene": "cells", "cell": "genes"}[axis]
    rename = lambda n: n.replace(other, "entries")
    size = frame.num_cells if axis == "gene" else frame.num_genes
    bounds = {rename(k): filters.as_count(v, size) if k.endswith(other) else v for k, v in kw.items()}
    return filters.in_order(frame.x, axis, frame.var if axis == "gene" else frame.obs, [rename(n) for n in order], **bounds)


@register(f"{P}.filter.gene", "FilterGenesScanpyOrder")
def filter_genes_in_order(frame: AnnotatedFrame, order=("min_counts", "min_cells", "max_counts", "max_cells"), **bounds) -> AnnotatedFrame:
    return frame.keep_genes(_ordered(frame, "gene", order, bounds))


@register(f"{P}.filter.cell", "FilterCellsScanpyOrder")
def filter_cells_in_order(frame: AnnotatedFrame, order=("min_counts", "min_genes", "max_counts", "max_genes"), **bounds) -> AnnotatedFrame:
    return frame.keep_cells(_ordered(frame, "cell", order, bounds))


@register(f"{P}.filter.cell", "FilterCellsCommonMod")
def filter_cells_common(frame: AnnotatedFrame, mod1: str, mod2: str) -> AnnotatedFrame:
    cells = frame.mod[mod1].obs.select("cell").join(frame.mod[mod2].obs.select("cell"), "cell", "left_semi")
    return frame.replace(mod={k: v.keep_cells(cells) if k in (mod1, mod2) else v for k, v in frame.mod.items()})


@register(f"{P}.filter.gene", "FilterGenesCommon")
def filter_genes_common(frame: AnnotatedFrame, batch_key: str | None = None, split_keys: Sequence[str] | None = None) -> AnnotatedFrame:
    if (batch_key is None) == (split_keys is None):
        raise ValueError("give either batch_key or split_keys")
    if batch_key:
        return frame.keep_genes(filters.common_by_group(frame.x, frame.obs.select("cell", batch_key), batch_key))
    return frame.keep_genes(filters.common_by_group(frame.x, frame.splits.where(F.col("split").isin(list(split_keys))), "split"))


@register(f"{P}.filter.gene", "FilterGenesMatch")
def filter_genes_match(frame: AnnotatedFrame, prefixes: Sequence[str] = (), suffixes: Sequence[str] = (), case_sensitive: bool = False, name: str = "gene_name", compat: bool = False) -> AnnotatedFrame:
    """compat: the flag has the opposite meaning."""
    return frame.keep_genes(filters.by_name(frame.var, prefixes, suffixes, case_sensitive != compat, name))


@register(f"{P}.filter.gene", "FilterGenesPercentile")
def filter_genes_percentile(frame: AnnotatedFrame, min_val: float = 1, max_val: float = 99, mode: str = "sum", whitelist_indicators: Sequence[str] = ()) -> AnnotatedFrame:
    return _with_whitelist(frame, filters.by_percentile(frame.x, frame.var, frame.num_cells, min_val, max_val, mode), whitelist_indicators)


@register(f"{P}.filter.gene", "FilterGenesTopK")
def filter_genes_top_k(frame: AnnotatedFrame, num_genes: int = 1000, top: bool = True, mode: str = "cv", whitelist_indicators: Sequence[str] = ()) -> AnnotatedFrame:
    return _with_whitelist(frame, filters.by_top_k(frame.x, frame.var, frame.num_cells, num_genes, top, mode), whitelist_indicators)


def _with_whitelist(frame: AnnotatedFrame, genes: DataFrame, flags: Sequence[str]) -> AnnotatedFrame:
    genes = genes.select("gene")
    for flag in flags:
        genes = genes.unionByName(frame.var.where(flag).select("gene"))
    return frame.keep_genes(genes)


@register(f"{P}.filter.gene", "FilterGenesMarker")
def filter_genes_marker(frame: AnnotatedFrame, label: str, threshold: float = 1.25, eps: float = 1e-6, subset: bool = True) -> AnnotatedFrame:
    found = filters.markers(stats.profile(frame.x, frame.obs, label), label, threshold, eps)
    frame = frame.put("uns", "markers", found)
    return frame.keep_genes(found) if subset else frame


@register(f"{P}.filter.gene", "FilterGenesMarkerGini")
def filter_genes_marker_gini(frame: AnnotatedFrame, label: str, subset: bool = True) -> AnnotatedFrame:
    found = filters.gini_markers(stats.profile(frame.x, frame.obs, label), stats.detection(frame.x, frame.obs, label), stats.label_counts(frame.obs, label), label, genes=frame.var)
    frame = frame.put("uns", "markers", found)
    return frame.keep_genes(found) if subset else frame


@register(f"{P}.filter.gene", "FilterGenesRegression")
def filter_genes_regression(frame: AnnotatedFrame, method: str = "enclasc", num_genes: int = 1000) -> AnnotatedFrame:
    return frame.keep_genes(filters.top_k(filters.regression_scores(frame.x, frame.var, frame.num_cells, method), num_genes, F.desc("score"), "gene"))


@register(f"{P}.filter.gene", "HighlyVariableGenesRawCount")
def variable_raw(frame: AnnotatedFrame, n_top_genes: int = 1000, span: float = 0.3, batch_key: str | None = None, subset: bool = True, channel: str | None = None) -> AnnotatedFrame:
    if not frame.num_genes:
        raise ValueError("there are no genes")
    return _selected(frame, selection.by_raw_counts(frame.layers[channel] if channel else frame.x, frame.obs, frame.var, n_top_genes, span, batch_key), subset)


@register(f"{P}.filter.gene", "HighlyVariableGenesLogarithmizedByTopGenes")
def variable_top(frame: AnnotatedFrame, n_top_genes: int = 1000, n_bins: int = 20, flavor: str = "seurat", batch_key: str | None = None, subset: bool = True) -> AnnotatedFrame:
    return _selected(frame, selection.by_dispersion(frame.x, frame.obs, frame.var, n_top_genes, n_bins, flavor, batch_key), subset)


@register(f"{P}.filter.gene", "HighlyVariableGenesLogarithmizedByMeanAndDisp")
def variable_cutoffs(frame: AnnotatedFrame, min_disp=0.5, max_disp=float("inf"), min_mean=0.0125, max_mean=3, n_bins: int = 20, flavor: str = "seurat", batch_key: str | None = None, subset: bool = True) -> AnnotatedFrame:
    """With a batch column the cut-offs hold for means over the batches."""
    if batch_key is None:
        d = filters.dispersion(frame.x, frame.var, frame.num_cells, n_bins, flavor)
    else:
        d = selection.batch_dispersions(frame.x, frame.obs, frame.var, frame.num_genes, n_bins, flavor, batch_key)
    return _selected(frame, filters.variable_by_cutoffs(d, min_disp, max_disp, min_mean, max_mean), subset)


def _selected(frame: AnnotatedFrame, genes: DataFrame, subset: bool) -> AnnotatedFrame:
    """The frame with only the genes, or with a column that marks them."""
    if subset:
        return frame.keep_genes(genes)
    marked = genes.select("gene", F.lit(True).alias("highly_variable"))
    var = frame.var.drop("highly_variable").join(marked, "gene", "left")
    return frame.replace(var=var.withColumn("highly_variable", F.coalesce("highly_variable", F.lit(False))))


@register(f"{P}.filter.cell", "ScrubletTransform")
def remove_doublets(frame: AnnotatedFrame, n_components: int = 30, sim_doublet_ratio: float = 2.0, expected_doublet_rate: float = 0.06, deviations: float = 3.0, seed: int = 0) -> AnnotatedFrame:
    """Without cells that look like sums of two others; scores are kept in obs."""
    made = lambda rows: features.projected(ordering.written(normalized_rows(rows, frame.num_genes)), n_components)
    scores = selection.doublet_scores(entries(frame), made, sim_doublet_ratio, expected_doublet_rate, seed=seed)
    kept = selection.singlets(scores, deviations).withColumnRenamed("score", "doublet_score")
    return frame.replace(obs=frame.obs.join(kept, "cell", "left")).keep_cells(kept)


@register(f"{P}.filter", "FilterScanpy")
def filter_axis(frame: AnnotatedFrame, axis: str = "gene", min_counts=None, max_counts=None, min_entries=None, max_entries=None, split_name: str | None = None, channel: str | None = None) -> AnnotatedFrame:
    """Cells or genes by thresholds on totals and on the number of nonzero entries."""
    if axis not in ("cell", "gene"):
        raise ValueError(f"the axis is cell or gene, not {axis!r}")
    kept = _bounds(frame, axis, split_name, channel, dict(min_counts=min_counts, max_counts=max_counts, min_entries=min_entries, max_entries=max_entries))
    return frame.keep_genes(kept) if axis == "gene" else frame.keep_cells(kept)


@register(f"{P}.filter.gene", "FilterGenesPlaceHolder")
@register(f"{P}.filter.gene", "FilterGenesNumberPlaceHolder")
def genes_unchanged(frame: AnnotatedFrame) -> AnnotatedFrame:
    """All genes, with their totals n_counts and cells n_cells in var."""
    s = filters.totals(frame.x, "gene", frame.var).withColumnRenamed("n_entries", "n_cells")
    return frame.replace(var=frame.var.drop("n_counts", "n_cells").join(s, "gene", "left"))


@register(f"{P}.filter.cell", "FilterCellsPlaceHolder")
def cells_unchanged(frame: AnnotatedFrame) -> AnnotatedFrame:
    """All cells, with their totals n_counts and genes n_genes in obs."""
    s = filters.totals(frame.x, "cell", frame.obs).withColumnRenamed("n_entries", "n_genes")
    return frame.replace(obs=frame.obs.drop("n_counts", "n_genes").join(s, "cell", "left"))


@register(f"{P}.normalize", "NormalizePlaceHolder")
@register(f"{P}.feature.cell", "FeatureCellPlaceHolder")
def unchanged(frame: AnnotatedFrame) -> AnnotatedFrame:
    return frame


@register(f"{P}.filter.cell", "FilterCellsType")
def filter_cells_type(frame: AnnotatedFrame, label: str, cell_type_threshold: int = 10) -> AnnotatedFrame:
    return frame.keep_cells(filters.small_types(frame.obs, label, cell_type_threshold))


@register(f"{P}.filter.cell", "FilterCellTransform")
def filter_cells_quality(frame: AnnotatedFrame, name: str = "gene_name") -> AnnotatedFrame:
    return frame.keep_cells(filters.good_cells(filters.cell_quality(frame.x, frame.obs, frame.var, name)))


@register(f"{P}.normalize", "ColumnSumNormalize")
def column_sum_normalize(frame: AnnotatedFrame, mode: str = "normalize", axis: int = 0, eps: float = -1, batch_key: str | None = None) -> AnnotatedFrame:
    return frame.replace(x=normalize.by_axis(frame.x, mode, "gene" if axis == 0 else "cell", eps, batch_key, frame.obs, frame.var))


@register(f"{P}.normalize", "NormalizeTotal")
def normalize_total(frame: AnnotatedFrame, target_sum: float | None = None, max_fraction: float = 0.05) -> AnnotatedFrame:
    return frame.replace(x=normalize.total(frame.x, target_sum, max_fraction))


@register(f"{P}.normalize", "Log1P")
def log1p(frame: AnnotatedFrame, base: float | None = None) -> AnnotatedFrame:
    return frame.replace(x=normalize.log1p(frame.x, base))


@register(f"{P}.normalize", "NormalizeTotalLog1P")
def normalize_total_log1p(frame: AnnotatedFrame, target_sum: float | None = None, max_fraction: float = 0.05, base: float | None = None) -> AnnotatedFrame:
    return frame.replace(x=normalize.total_log1p(frame.x, target_sum, max_fraction, base))


@register(f"{P}.normalize", "tfidfTransform")
def tfidf(frame: AnnotatedFrame) -> AnnotatedFrame:
    return frame.replace(x=normalize.tfidf(frame.x, frame.num_cells))


@register(f"{P}.normalize", "ScTransform")
def sc_transform(frame: AnnotatedFrame, min_cells: int = 5, theta: float = 100.0) -> AnnotatedFrame:
    """Pearson residuals with one overdispersion for all genes, for genes in min_cells cells or more."""
    genes = filters.by_thresholds(frame.x, "gene", frame.var, min_entries=min_cells)
    kept = frame.keep_genes(genes)
    return kept.replace(x=normalize.pearson_residuals(kept.x, kept.obs, kept.var, theta))


@register(f"{P}.normalize", "UpdateSizeFactors")
def update_size_factors(frame: AnnotatedFrame) -> AnnotatedFrame:
    return frame.replace(obs=frame.obs.join(normalize.size_factors(frame.x), "cell", "left"))


@register(f"{P}.misc", "SaveRaw")
def save_raw(frame: AnnotatedFrame, exist_ok: bool = False) -> AnnotatedFrame:
    if frame.raw is not None and not exist_ok:
        raise AttributeError("raw is set already")
    return frame.replace(raw=frame.x)


@register(f"{P}.misc", "UpdateRaw")
def update_raw(frame: AnnotatedFrame) -> AnnotatedFrame:
    return frame.replace(raw=frame.raw.join(frame.var.select("gene"), "gene", "left_semi"))


@register(f"{P}.misc", "RemoveSplit")
def remove_split(frame: AnnotatedFrame, split_name: str) -> AnnotatedFrame:
    return frame.pop(split_name)


@register(f"{P}.misc", "SetConfig")
def set_config(frame: AnnotatedFrame, config_dict: dict[str, Any]) -> AnnotatedFrame:
    return frame.set_config(**config_dict)


@register(f"{P}.misc", "AlignMod")
def align_mod(frame: AnnotatedFrame) -> AnnotatedFrame:
    from ..frame import common_genes

    genes = common_genes(frame.mod.values())
    return frame.replace(mod={k: v.keep_genes(genes) for k, v in frame.mod.items()})


@register(f"{P}.feature.gene", "GeneStats")
def gene_stats(frame: AnnotatedFrame, threshold: float = 0, pseudo: bool = False, split_name: str | None = None, fill_na: float | None = None, out: str = "GeneStats") -> AnnotatedFrame:
    part = frame.split(split_name) if split_name else frame
    table = stats.gene_stats(part.x, frame.var, part.num_cells, threshold, pseudo)
    return frame.put("varm", out, table if fill_na is None else table.na.fill(fill_na))


@register(f"{P}.pseudobulk", "CellTopicProfile")
def cell_topic_profile(frame: AnnotatedFrame, ct_key: str, method: str = "mean", out: str = "CellTopicProfile") -> AnnotatedFrame:
    return frame.put("varm", out, stats.profile(frame.x, frame.obs, ct_key, method))


@register(f"{P}.pseudobulk", "CellGiottoTopicProfile")
def cell_detection_profile(frame: AnnotatedFrame, ct_key: str, detection_threshold: float = 0, out: str = "CellGiottoTopicProfile") -> AnnotatedFrame:
    made = stats.profile(frame.x, frame.obs, ct_key) if detection_threshold < 0 else stats.detection(frame.x, frame.obs, ct_key, detection_threshold)
    return frame.put("varm", out, made)


@register(f"{P}.pseudobulk", "PseudoMixture")
def pseudo_mixture(frame: AnnotatedFrame, ct_key: str, n_pseudo: int = 1000, nc_min: int = 2, nc_max: int = 10, random_state: int = 0, in_split_name: str | None = None, out_split_name: str = "pseudo") -> AnnotatedFrame:
    part = frame.split(in_split_name) if in_split_name else frame
    x, share = sampling.pseudo_mixture(part.x, part.obs, ct_key, n_pseudo, nc_min, nc_max, random_state)
    made = AnnotatedFrame(x, share.select("cell").distinct(), frame.var)
    return frame.append(made, mode="new_split", new_split=out_split_name).put("obsm", "cell_type_portion", share)


@register(f"{P}.feature.cell", "BatchFeature")
def batch_feature(frame: AnnotatedFrame, batch_key: str = "batch", out: str = "BatchFeature") -> AnnotatedFrame:
    return frame.put("obsm", out, stats.cell_features(frame.x, frame.obs, frame.num_genes, batch_key))


def entries(frame: AnnotatedFrame) -> DataFrame:
    """(cell, i, v): a row for each cell, the places of its entries among the genes in order, and their values; null without entries."""
    codes = features.encoded(frame.var.select("gene"), "gene", "i")
    rows = frame.x.where("value is not null").join(codes, "gene").groupBy("cell").agg(F.collect_list("i").alias("i"), F.collect_list(F.col("value").cast("double")).alias("v"))
    return frame.obs.select("cell").join(rows, "cell", "left")


def dense(frame: AnnotatedFrame) -> DataFrame:
    """(cell, vec) over the genes in order; each cell's entries are put into place in one pass."""
    n = frame.num_genes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, n))
            for k, (at, v) in enumerate(zip(b.column(1), b.column(2))):
                if at.is_valid:
                    out[k, at.values.to_numpy()] = v.values.to_numpy()
            yield pa.record_batch([b.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=["cell", "vec"])

    full = entries(frame)
    return full.mapInArrow(run, f"cell {full.schema['cell'].dataType.simpleString()}, vec array<double>")


def normalized_rows(rows: DataFrame, n: int, target: float | None = None) -> DataFrame:
    """(cell, vec) of rows (cell, i, v) over n genes: each cell scaled to a total, then log1p, as NormalizeTotal and Log1P do.

    Entries of one place are added up first. target None is the median of the positive totals.
    """
    if target is None:
        total = F.aggregate(F.coalesce("v", F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + x)
        target = rows.select(total.alias("_t")).where("_t > 0").agg(F.median("_t")).first()[0] or 1.0
    some = max(1, (1 << 22) // max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(s, some) for s in range(0, whole.num_rows, some)):
                i, v, sizes = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy(), pc.list_value_length(b.column(1)).fill_null(0).to_numpy()
                at = np.repeat(np.arange(b.num_rows), sizes) * n + i
                out = np.bincount(at, v, minlength=b.num_rows * n).reshape(b.num_rows, n)
                t = out.sum(1)
                out = np.log1p(out / np.where(t > 0, t / target, 1.0)[:, None])
                yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * n), pa.array(out.ravel()))], names=["cell", "vec"])

    return rows.select("cell", "i", "v").mapInArrow(run, f"cell {rows.schema['cell'].dataType.simpleString()}, vec array<double>")


def _weighted(frame: AnnotatedFrame, n_components: int | float, split_name: str | None, feat_norm_mode: str | None, feat_norm_axis: int, centre: bool, out: str) -> AnnotatedFrame:
    part = frame.split(split_name) if split_name else frame
    if feat_norm_mode:
        part = column_sum_normalize(part, feat_norm_mode, feat_norm_axis)
    factors = features.gene_factors(dense(part), n_components, centre)
    genes = features.encoded(frame.var.select("gene"), "gene", "i").join(F.broadcast(factors), "i").drop("i")
    return frame.put("varm", out, genes).put("obsm", out, features.weighted_features(frame.x, genes))


@register(f"{P}.feature.cell", "WeightedFeaturePCA")
def weighted_pca(frame: AnnotatedFrame, n_components: int | float = 400, split_name: str | None = None, feat_norm_mode: str | None = None, feat_norm_axis: int = 0, out: str = "WeightedFeaturePCA") -> AnnotatedFrame:
    """Cells as means of gene PCA factors, weighted by their values."""
    return _weighted(frame, n_components, split_name, feat_norm_mode, feat_norm_axis, True, out)


@register(f"{P}.feature.cell", "WeightedFeatureSVD")
def weighted_svd(frame: AnnotatedFrame, n_components: int | float = 400, split_name: str | None = None, feat_norm_mode: str | None = None, feat_norm_axis: int = 0, out: str = "WeightedFeatureSVD") -> AnnotatedFrame:
    """Cells as means of gene SVD factors; a fraction of components is a share of the variance."""
    return _weighted(frame, n_components, split_name, feat_norm_mode, feat_norm_axis, False, out)


@register(f"{P}.feature.cell", "CellPCA")
def cell_pca(frame: AnnotatedFrame, n_components: int = 400, out: str = "CellPCA") -> AnnotatedFrame:
    return frame.put("obsm", out, features.projected(dense(frame), min(n_components, frame.num_genes)))


@register(f"{P}.feature.cell", "CellSVD")
def cell_svd(frame: AnnotatedFrame, n_components: int = 400, out: str = "CellSVD") -> AnnotatedFrame:
    return frame.put("obsm", out, features.projected(dense(frame), min(n_components, frame.num_genes), centre=False))


@register(f"{P}.feature.cell", "GaussRandProjFeature")
def random_projection(frame: AnnotatedFrame, n_components: int = 400, seed: int = 0, out: str = "GaussRandProjFeature") -> AnnotatedFrame:
    return frame.put("obsm", out, features.random_projection(frame.x, n_components, seed))


@register(f"{P}.feature.cell", "SCNFeature")
def pair_feature(frame: AnnotatedFrame, label: str, num_top_genes: int = 10, num_top_gene_pairs: int = 25, max_gene_per_ct: int = 3, out: str = "SCNFeature") -> AnnotatedFrame:
    pairs = features.gene_pairs(frame.x, frame.obs, label, num_top_genes, num_top_gene_pairs, max_gene_per_ct)
    return frame.put("obsm", out, features.pair_features(frame.x, pairs)).put("uns", out, pairs)


@register(f"{P}.feature.spatial", "SMEFeature")
def neighbour_smoothing(frame: AnnotatedFrame, graph: str, out: str = "SMEFeature") -> AnnotatedFrame:
    return frame.put("layers", out, graphs.smoothed(frame.x, frame.obsp[graph], 0.5))


@register(f"{P}.graph.cell", "NeighborGraph")
def neighbor_graph(frame: AnnotatedFrame, n_neighbors: int = 15, channel: str = "CellPCA", out: str = "NeighborGraph") -> AnnotatedFrame:
    return frame.put("obsp", out, graphs.nearest(frame.obsm[channel], n_neighbors).withColumn("weight", F.lit(1.0)))


@register(f"{P}.graph.spatial", "StagateGraph")
def radius_graph(frame: AnnotatedFrame, radius: float, x_key: str = "px", y_key: str = "py", out: str = "StagateGraph") -> AnnotatedFrame:
    points = frame.obs.select("cell", F.col(x_key).alias("px"), F.col(y_key).alias("py"))
    return frame.put("obsp", out, graphs.within_radius(points, radius).withColumn("weight", F.lit(1.0)))


@register(f"{P}.graph.feature", "FeatureFeatureGraph")
def feature_graph(frame: AnnotatedFrame, threshold: float = 0.3, out: str = "FeatureFeatureGraph") -> AnnotatedFrame:
    half = graphs.correlated(frame.x, frame.num_cells, threshold).select("src", "dst", F.lit(1.0).alias("weight"))
    both = half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return frame.put("varp", out, graphs.symmetric_norm(both))


@register(f"{P}.graph.cell", "CellFeatureGraph")
def cell_feature_graph(frame: AnnotatedFrame, out: str = "CellFeatureGraph") -> AnnotatedFrame:
    return frame.put("uns", out, graphs.looped(graphs.bipartite(frame.x)))


@register(f"{P}.graph.cell", "PCACellFeatureGraph")
def pca_cell_feature_graph(frame: AnnotatedFrame, n_components: int | float = 400, split_name: str | None = None, out: str = "PCACellFeatureGraph") -> AnnotatedFrame:
    """The cell-feature graph, with gene factors and weighted cell features as its node features."""
    return cell_feature_graph(weighted_pca(frame, n_components, split_name, out=out), out)


@register(f"{P}.graph.cell", "CellFeatureBipartiteGraph")
def cell_feature_bipartite(frame: AnnotatedFrame, out: str = "CellFeatureBipartiteGraph") -> AnnotatedFrame:
    return frame.put("uns", out, graphs.bipartite(frame.x))


@register(f"{P}.graph.cell", "HeteronetGraph")
def heteronet_graph(frame: AnnotatedFrame, k: int = 5, channel: str = "CellPCA", out: str = "HeteronetGraph") -> AnnotatedFrame:
    """Directed edges to the k nearest cells, and to the cell itself."""
    return frame.put("obsp", out, graphs.nearest(frame.obsm[channel], k + 1, itself=True).withColumn("weight", F.lit(1.0)))


@register(f"{P}.graph.reference", "DSTGraph")
def mutual_graph(frame: AnnotatedFrame, k: int = 30, channel: str = "CellPCA", out: str = "DSTGraph") -> AnnotatedFrame:
    """Mutual nearest neighbours in an embedding, with loops, symmetrically normalised."""
    near = graphs.mutual(graphs.nearest(frame.obsm[channel], k)).select("src", "dst", F.lit(1.0).alias("weight"))
    both = near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return frame.put("obsp", out, graphs.symmetric_norm(both, loops=True))


@register(f"{P}.graph.cell", "stdgcnGraph")
def spatial_links(frame: AnnotatedFrame, radius: float, space: str = "hard", x_key: str = "px", y_key: str = "py", out: str = "stdgcnGraph") -> AnnotatedFrame:
    """Links of cells at most a radius apart: weight 1 (hard) or 1 / distance (soft), symmetrically normalised with loops."""
    if space not in ("hard", "soft"):
        raise ValueError(f"unknown links {space!r}")
    edges = graphs.within_radius(_points(frame, x_key, y_key), radius, itself=False)
    weight = F.lit(1.0) if space == "hard" else 1 / F.greatest(F.col("distance"), F.lit(1e-12))
    return frame.put("obsp", out, graphs.symmetric_norm(edges.select("src", "dst", weight.alias("weight")), loops=True))


def _points(frame: AnnotatedFrame, x_key: str, y_key: str) -> DataFrame:
    return frame.obs.select("cell", F.col(x_key).cast("double").alias("px"), F.col(y_key).cast("double").alias("py"))


@register(f"{P}.graph.spatial", "SpaGCNGraph2D")
def distance_graph(frame: AnnotatedFrame, x_key: str = "px", y_key: str = "py", out: str = "SpaGCNGraph2D") -> AnnotatedFrame:
    """Distances of all pairs of cells: dense by nature."""
    points = _points(frame, x_key, y_key).select("cell", F.array("px", "py").alias("vec"))
    return frame.put("obsp", out, graphs.pair_distances(points))


@register(f"{P}.graph.spatial", "SpaGCNGraph")
def colour_distance_graph(frame: AnnotatedFrame, colours: Sequence[str], alpha: float = 1.0, x_key: str = "px", y_key: str = "py", out: str = "SpaGCNGraph", digits: int | None = None) -> AnnotatedFrame:
    """Distances of all pairs of cells in space and colour; colours name columns of obs, such as means of an image around a cell."""
    points = frame.obs.select("cell", F.col(x_key).cast("double").alias("px"), F.col(y_key).cast("double").alias("py"), *(F.col(c) for c in colours))
    return frame.put("obsp", out, graphs.pair_distances(graphs.with_colour(points, list(colours), alpha), digits=digits))


@register(f"{P}.graph.spatial", "SMEGraph")
def morphology_graph(frame: AnnotatedFrame, radius: float = 3, spot: Sequence[str] = ("sx", "sy"), pixel: Sequence[str] = ("px", "py"), images: str = "MorphologyFeatureCNN", genes: str = "CellPCA", out: str = "SMEGraph") -> AnnotatedFrame:
    """Pairs less than `radius` spots apart in pixels, weighed by likeness of image and expression."""
    fit = frame.obs.agg(*(F.regr_slope(F.col(p).cast("double"), F.col(s).cast("double")).alias(f"b{k}") for k, (p, s) in enumerate(zip(pixel, spot)))).first()
    unit = ((fit.b0 or 0.0) ** 2 + (fit.b1 or 0.0) ** 2) ** 0.5
    return frame.put("obsp", out, graphs.morphology_weights(_points(frame, *pixel), radius * unit, frame.obsm[images], frame.obsm[genes]))


@register(f"{P}.graph.cell", "ScMoGNNGraph")
def gene_set_and_cell_graph(frame: AnnotatedFrame, gene_sets: DataFrame | None = None, threshold: float = 0.3, weight: str = "pearson", out: str = "ScMoGNNGraph") -> AnnotatedFrame:
    """Cell-gene edges both ways, and edges of genes that share a set (pathway, gene) and correlate."""
    edges = graphs.bipartite(frame.x)
    if gene_sets is not None:
        near = spatial.gene_set_graph(frame.x, gene_sets, frame.num_cells, threshold, weight)
        named = near.select(F.concat(F.lit("g:"), "src").alias("src"), F.concat(F.lit("g:"), "dst").alias("dst"), "weight")
        edges = edges.unionByName(named).unionByName(named.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return frame.put("uns", out, edges)


@register(f"{P}.graph.cell", "EfNSTGraphTransform")
def neighbour_links(frame: AnnotatedFrame, k: int = 12, radius: float | None = None, x_key: str = "px", y_key: str = "py", out: str = "EfNSTGraph") -> AnnotatedFrame:
    """The k nearest cells in space, or those within a radius; a cell is no neighbour of its own."""
    points = _points(frame, x_key, y_key)
    edges = graphs.within_radius(points, radius, itself=False) if radius else graphs.nearest(points.select("cell", F.array("px", "py").alias("vec")), k)
    return frame.put("obsp", out, edges.select("src", "dst", F.lit(1.0).alias("weight")))


@register(f"{P}.misc", "EfNSTAugmentTransform")
def augment(frame: AnnotatedFrame, graph: str = "EfNSTGraph", weight: float = 0.2, out: str = "augmented") -> AnnotatedFrame:
    return frame.put("layers", out, spatial.augmented(frame.x, frame.obsp[graph], weight))


@register(f"{P}.misc", "EfNSTConcatgTransform")
def joined_features(frame: AnnotatedFrame, channels: Sequence[str], out: str = "joined") -> AnnotatedFrame:
    """Embeddings (cell, vec) put end to end."""
    vecs, rows = [], frame.obs.select("cell")
    for k, name in enumerate(channels):
        rows = rows.join(frame.obsm[name].select("cell", F.col("vec").alias(f"_{k}")), "cell")
        vecs.append(f"_{k}")
    return frame.put("obsm", out, rows.select("cell", F.concat(*vecs).alias("vec")))


@register(f"{P}.data.interagration", "DataInteragraionTransform")
def integrate(frame: AnnotatedFrame, batch_key: str = "batch", batch_removal: str = "combat", n_components: int | None = 30, out: str = "DataInteragraionTransform") -> AnnotatedFrame:
    """Batches brought to one location and scale, then PCA scores."""
    if batch_removal not in ("combat", "none"):
        raise ValueError(f"unknown adjustment {batch_removal!r}")
    part = frame if batch_removal == "none" else frame.replace(x=spatial.batch_adjusted(frame.x, frame.obs, batch_key))
    return frame.put("layers", out, part.x) if n_components is None else frame.put("obsm", out, features.projected(dense(part), n_components))


@register(f"{P}.feature.spatial", "TangramFeature")
def tangram_feature(frame: AnnotatedFrame, density_mode: str = "uniform", split_name: str | None = None, out: str = "density") -> AnnotatedFrame:
    part = frame.split(split_name) if split_name else frame
    return frame.put("obsm", out, spatial.density(part.x, part.obs, density_mode))


@register(f"{P}.feature.spatial", "SpatialIDEFeature")
def stabilized_residuals(frame: AnnotatedFrame, out: str = "SpatialIDEFeature") -> AnnotatedFrame:
    """Variance-stabilised values less their regression on the log totals of the cells."""
    size = frame.x.groupBy("cell").agg(F.log(F.sum("value")).alias("c"))
    size = frame.obs.select("cell").join(size, "cell", "left").na.fill(0.0, ["c"])
    return frame.put("layers", out, normalize.regress_out(normalize.stabilize(frame.x, frame.obs, frame.var), size))


@register(f"{P}.pseudobulk", "CellTypeNums")
@register(f"{P}.misc", "CellTypeNum")
def cell_type_counts(frame: AnnotatedFrame, ct_key: str, out: str = "CellTypeNums") -> AnnotatedFrame:
    return frame.put("uns", out, stats.label_counts(frame.obs, ct_key))


@register(f"{P}.pseudobulk", "pseudoSpotGen")
def pseudo_spots(frame: AnnotatedFrame, ct_key: str, spot_num: int = 1000, min_cell_number_in_spot: int = 8, max_cell_number_in_spot: int = 12, max_cell_types_in_spot: int = 4, seed: int = 0, split_name: str | None = None, out_split_name: str = "pseudo") -> AnnotatedFrame:
    part = frame.split(split_name) if split_name else frame
    x, share = spatial.pseudo_spots(part.x, part.obs, ct_key, spot_num, min_cell_number_in_spot, max_cell_number_in_spot, max_cell_types_in_spot, seed)
    made = AnnotatedFrame(x, share.select("cell").distinct(), frame.var)
    return frame.append(made, mode="new_split", new_split=out_split_name).put("obsm", "cell_type_portion", share)


@register(f"{P}.misc", "CelltypeTransform")
def encode_cell_types(frame: AnnotatedFrame, ct_key: str, out: str = "cell_type_idx") -> AnnotatedFrame:
    """Cell types as numbers 0, 1, ... in their order, in a column of obs; the types by number in uns."""
    obs = features.encoded(frame.obs, ct_key, out)
    return frame.replace(obs=obs).put("uns", out, obs.select(ct_key, out).distinct())


@register(f"{P}.misc", "updateAnndataObsTransform")
def update_obs(frame: AnnotatedFrame, table: DataFrame) -> AnnotatedFrame:
    """obs with the columns of a table (cell, ...), which replace those of one name."""
    return frame.replace(obs=frame.obs.drop(*(c for c in table.columns if c != "cell")).join(table, "cell", "left"))


@register(f"{P}.normalize", "STPreprocessTransform")
def spatial_preprocess(frame: AnnotatedFrame, normalize_total: bool = True, log1p: bool = True, highly_variable: int | None = None, regress: bool = False, scale: bool = False, genes: DataFrame | None = None) -> AnnotatedFrame:
    """Totals, logs, variable genes, regression on totals and scaling in this order, as asked; then only the given genes."""
    totals = filters.totals(frame.x, "cell", frame.obs).select("cell", F.col("n_counts").cast("double").alias("c"))
    if normalize_total:
        frame = frame.replace(x=normalize.total(frame.x, 1e4, 1.0))
    if log1p:
        frame = frame.replace(x=normalize.log1p(frame.x))
    if highly_variable:
        frame = variable_top(frame, highly_variable)
    if regress:
        frame = frame.replace(x=normalize.regress_out(normalize.filled(frame.x, frame.obs, frame.var), totals))
    if scale:
        frame = column_sum_normalize(frame, "standardize")
    return frame if genes is None else frame.keep_genes(genes.select("gene"))


@register(f"{P}.misc", "filter_data")
def filter_normalize_select(frame: AnnotatedFrame, highly_genes: int = 500) -> AnnotatedFrame:
    """A fixed chain: cells and genes that hold something, totals of 10,000, logs, the most variable genes."""
    frame = filter_genes(filter_cells(frame, min_genes=1), min_cells=3)
    return variable_top(normalize_total_log1p(frame, 1e4, 1.0), highly_genes, flavor="cell_ranger")


@register(f"{P}.misc", "normalize_adata")
def normalize_counts(frame: AnnotatedFrame, filter_min_counts: bool = True, size_factors: bool = True, normalize_input: bool = True, logtrans_input: bool = True) -> AnnotatedFrame:
    """Empty cells and genes out, raw kept, size factors in obs, totals scaled to their median, logs, standardised genes, as asked."""
    if filter_min_counts:
        frame = filter_cells(filter_genes(frame, min_counts=1), min_counts=1)
    frame = frame.replace(raw=frame.x)
    if size_factors:
        frame = update_size_factors(frame)
        frame = frame.replace(x=normalize.total(frame.x, None, 1.0))
    if logtrans_input:
        frame = frame.replace(x=normalize.log1p(frame.x))
    return column_sum_normalize(frame, "standardize") if normalize_input else frame


@register(f"{P}.split.entry", "CellwiseMaskData")
def cellwise_mask(frame: AnnotatedFrame, distr: str = "exp", mask_rate: float = 0.1, seed: int = 0, min_gene_counts: int = 5, add_test_mask: bool = False) -> AnnotatedFrame:
    return frame.put("layers", "mask", sampling.mask_cellwise(frame.x, mask_rate, distr, seed, min_gene_counts, valid_share=0.1 if add_test_mask else None))


@register(f"{P}.split.entry", "MaskData")
def mask_data(frame: AnnotatedFrame, mask_rate: float = 0.1, seed: int = 0, compat: bool = False) -> AnnotatedFrame:
    return frame.put("layers", "train_mask", sampling.mask_entries(frame.x, mask_rate, seed, compat))


@register(f"{P}.split.gene", "GeneHoldout")
def gene_holdout(frame: AnnotatedFrame, n_top: int = 5, batch_size: int = 512, out: str = "GeneHoldout") -> AnnotatedFrame:
    batches = max(1, -(-frame.num_genes // batch_size))
    return frame.put("uns", out, filters.top_covarying(frame.x, frame.num_cells, F.pmod(F.xxhash64("gene"), F.lit(batches)), n_top))


@register(f"{P}.interface", "AnnDataTransform")
def apply_function(frame: AnnotatedFrame, func: Callable[..., AnnotatedFrame], **kwargs: Any) -> AnnotatedFrame:
    """Any function of a frame."""
    return func(frame, **kwargs)


@register(f"{P}.misc", "Compose")
def composed(frame: AnnotatedFrame, transforms: Sequence[Callable[[AnnotatedFrame], AnnotatedFrame]]) -> AnnotatedFrame:
    """Transforms one after another."""
    return compose(*transforms)(frame)


def compose(*steps: Callable[[AnnotatedFrame], AnnotatedFrame]) -> Callable[[AnnotatedFrame], AnnotatedFrame]:
    for step in steps:
        if not callable(step):
            raise TypeError(f"{step!r} is not a transform")

    def run(frame: AnnotatedFrame) -> AnnotatedFrame:
        for step in steps:
            frame = step(frame)
        return frame

    return run
