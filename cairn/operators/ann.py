"""Approximate candidates from saved index tables. They only reduce the rows that exact scoring sees.

Inverted lists are Parquet partitioned by list, so a probe reads its lists alone. Graphs are built per
shard of ``SHARD_ROWS`` rows (one task each) and searched shard by shard; each shard returns its best
``ef`` nodes. Training reads at most ``TRAIN_ROWS`` rows, those with the smallest hash of their key.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.graphs import Graph
from cairn.functions.quantize import ProductQuantizer, RaBitQ, kmeans, metric_scores, nearest, scalar_codes
from cairn.schema import PK, IndexParams
from cairn.sources.revisions import Store

TRAIN_ROWS, SHARD_ROWS = 20_000, 4096


def ordinals(keys: DataFrame) -> DataFrame:
    """Each key with its place in key order: rows are counted per range partition, then within."""
    parts = keys.repartitionByRange(PK).sortWithinPartitions(PK).withColumn("_part", F.spark_partition_id())
    parts = parts.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(PK)) - 1)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return parts.join(F.broadcast(before), "_part").select(PK, (F.col("_before") + F.col("_in")).alias("_doc_id"))


@dataclass(frozen=True)
class SavedIndex:
    store: Store
    folder: str
    model: dict[str, Any]

    def table(self, name: str) -> DataFrame:
        return self.store.spark.read.parquet(f"{self.store.root}/{self.folder}/{name}")


def _sample(rows: DataFrame) -> np.ndarray:
    picked = rows.select("v", F.xxhash64(PK).alias("h"), PK).orderBy("h", PK).limit(TRAIN_ROWS).select("v").collect()
    return np.array([r.v for r in picked], np.float64).reshape(len(picked), -1)


def soar(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Each row's second list: near, with a residual that is not parallel to the first one's (lambda 1)."""
    far = nearest(x, centers)
    first = far.argmin(1)
    r1 = x - centers[first]
    unit = r1 / np.maximum(np.linalg.norm(r1, axis=1, keepdims=True), 1e-30)
    along = (x * unit).sum(1)[:, None] - unit @ centers.T
    loss = far + along**2
    loss[np.arange(len(x)), first] = np.inf
    return loss.argmin(1) if centers.shape[0] > 1 else first


def _lists(model: dict[str, Any], quantize: str, bits: int, use_soar: bool):
    centers = np.array(model["centers"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coders = [RaBitQ(c, bits) for c in centers] if bits else []
        for pdf in frames:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_list()).astype(np.float64)
            at = nearest(x, centers).argmin(1)
            for lists in [at, soar(x, centers)] if use_soar and len(centers) > 1 else [at]:
                out = pd.DataFrame({PK: pdf[PK], "list_id": lists.astype(np.int32), "norm": (x * x).sum(1), "factor": 0.0})
                if bits:
                    codes = np.zeros((len(x), coders[0].turn.size), np.int16)
                    for c in np.unique(lists):
                        codes[lists == c], out.loc[out.index[lists == c], "factor"] = coders[c].encode(x[lists == c])
                    out["code"] = list(codes)
                    out["kept"] = [None] * len(out)
                else:
                    out["code"] = [None] * len(out)
                    out["kept"] = list((scalar_codes(x, quantize) if quantize != "none" else x).astype(np.float32))
                yield out

    return run


def _graph(kind: str, p: dict[str, Any], bits: int, chunks: int):
    degree, beam = (p["m"], p["ef_construction"]) if "m" in p else (p["max_degree"], p["list_size"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(PK)
        x = np.stack(pdf["v"].to_list()).astype(np.float64)
        shown: Any = x
        if bits:
            shown = RaBitQ(x.mean(0), bits)
            shown = (shown, *shown.encode(x), (x * x).sum(1))
        elif chunks:
            pq = ProductQuantizer.train(x, chunks)
            shown = (pq, pq.encode(x))
        elif p.get("quantize", "none") != "none":
            shown = scalar_codes(x, p["quantize"])
        graph = Graph.build(x, p["metric"], degree, max(beam, degree), "m" in p, p.get("alpha", 1.0))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "keys": [pdf[PK].to_list()], "graph": [pickle.dumps((graph.layers, graph.entry, shown))]})

    return run


def build(store: Store, folder: str, rows: DataFrame, index: IndexParams) -> None:
    """Write an index of rows (_pk, v) below a folder; its marker comes last."""
    p, kind = index.params, index.kind
    path = f"{store.root}/{folder}"
    model: dict[str, Any] = {"kind": kind}
    if kind in ("ivf", "ivf_rabitq"):
        sample = _sample(rows)
        rounds = (p.get("n_iters") or 3) if kind == "ivf" else 5
        model["centers"] = kmeans(sample, p["n_lists"], rounds).tolist() if len(sample) else []
        model["bits"] = p.get("bits", 0)
        if len(sample):
            made = rows.mapInPandas(_lists(model, p.get("quantize", "none"), model["bits"], p.get("use_soar", False)), f"{PK} string, list_id int, norm double, factor double, code array<short>, kept array<float>")
            made.repartition("list_id").write.partitionBy("list_id").parquet(f"{path}/lists")
    else:
        n = rows.count()
        shards = max(1, -(-n // SHARD_ROWS))
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64(PK), F.lit(shards)))
        dealt.groupBy("shard").applyInPandas(_graph(kind, p, p.get("bits", 0), p.get("pq_chunk_num", 0)), "shard int, keys array<string>, graph binary").write.parquet(f"{path}/shards")
    store.write_text(f"{folder}/model.json", json.dumps(model))
    store.write_text(f"{folder}/_ready", "")


def load(store: Store, folder: str) -> SavedIndex:
    return SavedIndex(store, folder, json.loads(store.read_text(f"{folder}/model.json")))


def probed(model: dict[str, Any], query: np.ndarray, nprobe: int) -> list[int]:
    """The nearest lists by L2, whatever the metric; by default the square root of their number."""
    centers = np.array(model["centers"])
    n = nprobe or int(np.ceil(np.sqrt(len(centers))))
    return [int(i) for i in nearest(query[None], centers)[0].argsort(kind="stable")[:n]]


def _estimated(model: dict[str, Any], query: np.ndarray, metric: str):
    centers, bits = np.array(model["centers"]), model["bits"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            score = np.zeros(len(pdf))
            for c, rows in pdf.reset_index(drop=True).groupby("list_id"):
                at = rows.index.to_numpy()
                if bits:
                    score[at] = RaBitQ(centers[c], bits).scores(np.stack(rows["code"].to_list()).astype(np.float64), rows["factor"].to_numpy(), rows["norm"].to_numpy(), query, metric)
                else:
                    score[at] = metric_scores(np.stack(rows["kept"].to_list()).astype(np.float64), query, metric)
            yield pd.DataFrame({PK: pdf[PK], "score": score})

    return run


def _search_shards(query: np.ndarray, metric: str, ef: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = [pd.DataFrame({PK: [], "score": []})]
        for keys, blob, good in zip(pdf["keys"], pdf["graph"], pdf["allowed"], strict=True):
            layers, entry, shown = pickle.loads(blob)
            allowed = None if good is None else np.isin(np.array(keys, object), np.array(list(good), object))
            if isinstance(shown, tuple):
                coder, codes = shown[0], shown[1].astype(np.float64) if len(shown) > 2 else shown[1]
                s = coder.scores(codes, shown[2], shown[3], query, metric) if len(shown) > 2 else coder.scores(codes, query, metric)
                # Navigation by estimates: the graph is walked over one-dimensional score vectors.
                found = Graph(layers, entry).search(s[:, None], np.ones(1), "ip", ef, allowed)
            else:
                found = Graph(layers, entry).search(shown, query, metric, ef, allowed)
            made.append(pd.DataFrame({PK: [keys[i] for _, i in found], "score": [float(v) for v, _ in found]}))
        return pd.concat(made[1:] or made)

    return run


def candidates(saved: SavedIndex, index: IndexParams, query, metric: str, k: int, params: dict[str, Any], allowed: DataFrame | None) -> DataFrame:
    """Keys of candidates for a query, among ``allowed`` keys if given."""
    q = np.array(query, np.float64)
    if "centers" in saved.model:
        lists = probed(saved.model, q, params.get("nprobe", 0))
        table = saved.table("lists")
        if allowed is not None:
            # Widen the probe until its lists hold enough allowed rows; counts per list, nearest first.
            order = probed(saved.model, q, len(saved.model["centers"]))
            held = table.join(allowed, PK, "left_semi").groupBy("list_id").agg(F.count_distinct(PK).alias("n")).collect()
            counts = {r["list_id"]: r["n"] for r in held}  # one number per list
            while len(lists) < len(order) and sum(counts.get(c, 0) for c in lists) < k:
                lists = order[: len(lists) + 1]
            table = table.join(allowed, PK, "left_semi")
        rows = table.where(F.col("list_id").isin(lists))
        scale = params.get("scale_factor") or (4.0 if index.kind == "ivf_rabitq" else 0.0)
        if scale or index.kind == "ivf_rabitq":
            most = max(k, int(np.ceil(k * scale)))
            scored = rows.mapInPandas(_estimated(saved.model, q, metric), f"{PK} string, score double").groupBy(PK).agg(F.max("score").alias("score"))
            return scored.orderBy(F.col("score").desc(), PK).limit(most).select(PK)
        return rows.select(PK).distinct()
    shards = saved.table("shards")
    ef = max(k, params.get("ef") or params.get("list_size") or index.params.get("ef_construction") or index.params.get("list_size"))
    if allowed is None:
        asked = shards.withColumn("allowed", F.lit(None).cast("array<string>"))
    else:
        n = shards.count()
        mine = allowed.withColumn("shard", F.pmod(F.xxhash64(PK), F.lit(n)).cast("int")).groupBy("shard").agg(F.collect_list(PK).alias("allowed"))
        asked = shards.join(mine, "shard")  # at most SHARD_ROWS or so keys in a shard
    # A group is a shard, so a worker holds one at a time; a batch of rows would be as many graphs as a partition has.
    found = asked.select("shard", "keys", "graph", "allowed").groupBy("shard").applyInPandas(_search_shards(q, metric, ef), f"{PK} string, score double")
    return found.orderBy(F.col("score").desc(), PK).limit(ef).select(PK)
