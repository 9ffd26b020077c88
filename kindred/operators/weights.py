"""Weights of encoders: import from published names, token tables of another vocabulary, kept as tables, checkpoints by step."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.neural import Weights, random_transformer


@dataclass(frozen=True)
class EncoderConfig:
    """The sizes of an encoder, under the names of published configuration files; other entries of such a file are passed over."""

    vocab_size: int
    hidden_size: int
    num_hidden_layers: int
    num_attention_heads: int
    intermediate_size: int
    max_position_embeddings: int = 512
    embedding_size: int | None = None
    shared_layers: bool = False
    relative_positions: bool = False

    @staticmethod
    def of(text: str) -> EncoderConfig:
        known = {f.name for f in fields(EncoderConfig)}
        return EncoderConfig(**{k: v for k, v in json.loads(text).items() if k in known})

    def options(self) -> dict:
        """Of `neural.transformer`."""
        return {"layers": self.num_hidden_layers, "heads": self.num_attention_heads, "shared": self.shared_layers, "relative": self.relative_positions}

    def random(self, seed: int = 1) -> Weights:
        return random_transformer(vocab=self.vocab_size, size=self.hidden_size, layers=self.num_hidden_layers, hidden=self.intermediate_size, length=self.max_position_embeddings, seed=seed)


#: Where the parts of a block stand in published files, by their names here.
BLOCK_PARTS = {"q": "attention/self/query", "k": "attention/self/key", "v": "attention/self/value", "o": "attention/output/dense", "in": "intermediate/dense", "out": "output/dense"}
BLOCK_NORMS = {"1": "attention/output/LayerNorm", "2": "output/LayerNorm"}
TABLES = {"token": "word_embeddings", "segment": "token_type_embeddings", "position": "position_embeddings"}


def published_names(layers: int, scoped: bool = False, prefix: str = "bert") -> dict[str, str]:
    """The published name of each weight here: parted by dots, with weights of dense layers turned, or, `scoped`, by slashes, with kernels as they are."""

    def name(path: str, kind: str) -> str:
        return f"{prefix}/{path}/{kind}" if scoped else f"{prefix}/{path}/{kind}".replace("/", ".")

    kernel, gamma, beta = ("kernel", "gamma", "beta") if scoped else ("weight", "weight", "bias")
    out = {here: f"{prefix}/embeddings/{there}" if scoped else name(f"embeddings/{there}", "weight") for here, there in TABLES.items()}
    out |= {"embed.g": name("embeddings/LayerNorm", gamma), "embed.beta": name("embeddings/LayerNorm", beta), "pooler.w": name("pooler/dense", kernel), "pooler.b": name("pooler/dense", "bias")}
    for k in range(layers):
        at = f"encoder/layer_{k}" if scoped else f"encoder/layer/{k}"
        for part, path in BLOCK_PARTS.items():
            out |= {f"block{k}.{part}.w": name(f"{at}/{path}", kernel), f"block{k}.{part}.b": name(f"{at}/{path}", "bias")}
        for n, path in BLOCK_NORMS.items():
            out |= {f"block{k}.g{n}": name(f"{at}/{path}", gamma), f"block{k}.b{n}": name(f"{at}/{path}", beta)}
    return out


def chosen_rows(table: np.ndarray, keep: list[int] | None = None, compound: list | None = None) -> np.ndarray:
    """A token table of another vocabulary: the rows `keep`, then for each entry of `compound` the mean of the rows it lists, or of (rows, weights) the weighted one."""
    table = table if keep is None else table[np.array(keep, int)]
    made = [np.average(table[np.array(x[0] if isinstance(x, tuple) else x, int)], axis=0, weights=x[1] if isinstance(x, tuple) else None) for x in compound or ()]
    return np.concatenate([table, np.array(made)]) if made else table


def imported(published: Mapping[str, np.ndarray], config: EncoderConfig, *, scoped: bool = False, prefix: str = "bert", keep: list[int] | None = None, compound: list | None = None, seed: int = 1) -> tuple[Weights, list[str]]:
    """(weights, names not found): each weight from its published name; those that are not there stay random. A shape that differs is an error."""
    weights, missing = config.random(seed), []
    for here, there in published_names(1 if config.shared_layers else config.num_hidden_layers, scoped, prefix).items():
        if there not in published:
            missing.append(there)
            continue
        value = np.asarray(published[there], float)
        value = value.T if not scoped and here.endswith(".w") else chosen_rows(value, keep, compound) if here == "token" else value
        if here != "token" and value.shape != weights[here].shape:
            raise ValueError(f"{there} has the shape {value.shape}, not {weights[here].shape}")
        weights[here] = value
    return weights, missing


def weight_table(spark: SparkSession, weights: Weights) -> DataFrame:
    """(name, shape, data): a row a weight, to be written and read as any table."""
    rows = [(k, list(v.shape), np.ascontiguousarray(v, "<f8").tobytes()) for k, v in sorted(weights.items())]
    return spark.createDataFrame(rows, "name string, shape array<int>, data binary")


def weights_of(table: DataFrame) -> Weights:
    """Weights are of a model's fixed size, so the driver holds them."""
    return {r["name"]: np.frombuffer(bytes(r["data"]), "<f8").reshape(r["shape"]).copy() for r in table.collect()}


class Checkpoints:
    """Weights by step in a shared folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def save(self, step: int, weights: Weights) -> None:
        weight_table(self.spark, weights).withColumn("step", F.lit(step).cast("long")).coalesce(1).write.mode("append").partitionBy("step").parquet(self.path)

    def steps(self) -> list[int]:
        return sorted(int(r["step"]) for r in self.spark.read.parquet(self.path).select("step").distinct().collect())

    def load(self, step: int | None = None) -> tuple[int, Weights]:
        """The weights of a step, by default of the last one."""
        step = self.steps()[-1] if step is None else step
        found = weights_of(self.spark.read.parquet(self.path).where(F.col("step") == step))
        if not found:
            raise KeyError(f"no weights of step {step}")
        return step, found
