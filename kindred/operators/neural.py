"""Forward passes of pair encoders in NumPy, for inference inside Arrow batches. Weights are dictionaries of arrays; nothing trains here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.functions.codepoints import tokens

Weights = dict[str, np.ndarray]


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "gelu": gelu, "relu": lambda x: np.maximum(x, 0), "tanh": np.tanh, "sigmoid": sigmoid, "linear": lambda x: x, "swish": lambda x: x * sigmoid(x),
    "mish": lambda x: x * np.tanh(np.log1p(np.exp(x))), "softplus": lambda x: np.log1p(np.exp(x)), "elu": lambda x: np.where(x > 0, x, np.exp(np.minimum(x, 0)) - 1),
    "selu": lambda x: 1.0507009873554805 * np.where(x > 0, x, 1.6732632423543772 * (np.exp(np.minimum(x, 0)) - 1)), "leaky_relu": lambda x: np.where(x > 0, x, 0.01 * x),
    "softsign": lambda x: x / (1 + np.abs(x)), "exponential": np.exp, "softmax": softmax,
}


def activation(name: str) -> Callable[[np.ndarray], np.ndarray]:
    if name not in ACTIVATIONS:
        raise ValueError(f"no activation {name!r}")
    return ACTIVATIONS[name]


def layer_norm(x: np.ndarray, gamma: np.ndarray, beta: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps) * gamma + beta


def dense(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return x @ w[f"{name}.w"] + w[f"{name}.b"]


def sinusoid(positions: int, size: int) -> np.ndarray:
    angle = np.arange(positions)[:, None] / 10000 ** (2 * (np.arange(size) // 2) / size)
    return np.where(np.arange(size) % 2 == 0, np.sin(angle), np.cos(angle))


def positions(table: np.ndarray, n: int, alpha: float = 0.4) -> np.ndarray:
    """Position embeddings; beyond the table, position p is made hierarchically of those of p // size and p % size."""
    size = len(table)
    if n <= size:
        return table[:n]
    base = (table - alpha * table[:1]) / (1 - alpha)
    at = np.arange(n)
    return alpha * base[at // size] + (1 - alpha) * base[at % size]


def relative_positions(n: int, m: int, size: int, most: int = 64) -> np.ndarray:
    """[n, m, size] of clipped offsets through a sinusoid table."""
    offset = np.clip(np.arange(m)[None, :] - np.arange(n)[:, None], -most, most) + most
    return sinusoid(2 * most + 1, size)[offset]


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, mask: np.ndarray | None = None, relative: np.ndarray | None = None) -> np.ndarray:
    """softmax((q k + q r) / sqrt(d)) (v + r) over [batch, heads, length, d]; mask is 1 for tokens."""
    scores = q @ np.swapaxes(k, -1, -2)
    if relative is not None:
        scores = scores + np.einsum("bhqd,qkd->bhqk", q, relative)
    scores = scores / np.sqrt(q.shape[-1])
    if mask is not None:
        scores = scores + (1 - mask[:, None, None, :]) * -1e9
    p = softmax(scores)
    out = p @ v
    return out if relative is None else out + np.einsum("bhqk,qkd->bhqd", p, relative)


def self_attention(x: np.ndarray, w: Weights, name: str, heads: int, mask: np.ndarray, relative: np.ndarray | None = None) -> np.ndarray:
    b, n, d = x.shape
    split = lambda y: y.reshape(b, n, heads, d // heads).transpose(0, 2, 1, 3)
    q, k, v = (split(dense(x, w, f"{name}.{part}")) for part in "qkv")
    return dense(attention(q, k, v, mask, relative).transpose(0, 2, 1, 3).reshape(b, n, d), w, f"{name}.o")


def feed_forward(x: np.ndarray, w: Weights, name: str, act: str | list[str] = "gelu") -> np.ndarray:
    """One hidden layer; a list of activations makes it gated."""
    acts = [act] if isinstance(act, str) else act
    hidden = activation(acts[0])(dense(x, w, f"{name}.in"))
    for k, extra in enumerate(acts[1:], 1):
        hidden = hidden * activation(extra)(dense(x, w, f"{name}.in{k}"))
    return dense(hidden, w, f"{name}.out")


def transformer(ids: np.ndarray, segments: np.ndarray, w: Weights, *, layers: int, heads: int, shared: bool = False, relative: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """(last states, all states): post-norm blocks over token, segment and absolute position embeddings.

    `shared` uses one block throughout, `relative` offsets in place of absolute positions. Id 0 is padding.
    """
    mask = (ids != 0).astype(float)
    x = w["token"][ids] + w["segment"][segments]
    if "token_projection.w" in w:
        x = dense(x, w, "token_projection")
    if not relative:
        x = x + positions(w["position"], ids.shape[1])
    x = layer_norm(x, w["embed.g"], w["embed.beta"])
    r = relative_positions(ids.shape[1], ids.shape[1], x.shape[-1] // heads) if relative else None
    states = [x]
    for k in range(layers):
        name = "block0" if shared else f"block{k}"
        x = layer_norm(x + self_attention(x, w, name, heads, mask, r), w[f"{name}.g1"], w[f"{name}.b1"])
        x = layer_norm(x + feed_forward(x, w, name), w[f"{name}.g2"], w[f"{name}.b2"])
        states.append(x)
    return x, states


def pooled(states: list[np.ndarray], mask: np.ndarray, w: Weights, how: str = "cls") -> np.ndarray:
    """Sentence vectors: the first token's, through the tanh pooler, or means of the last, or first and last, states."""
    if how == "cls":
        return states[-1][:, 0]
    if how == "pooler":
        return np.tanh(dense(states[-1][:, 0], w, "pooler"))
    x = states[-1] if how == "last-avg" else (states[-1] + states[1 if len(states) > 1 else 0]) / 2
    return (x * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)


def masked_logits(x: np.ndarray, w: Weights) -> np.ndarray:
    """The tied language-model head."""
    h = layer_norm(gelu(dense(x, w, "mlm")), w["mlm.g"], w["mlm.beta"])
    return h @ w["token"].T + w["mlm.bias"]


def next_sentence(states: list[np.ndarray], w: Weights) -> np.ndarray:
    """Probabilities that the second text follows the first, or does not, from the pooled first token."""
    return softmax(dense(pooled(states, np.ones(states[-1].shape[:2]), w, "pooler"), w, "nsp"))


def pair_probabilities(ids: np.ndarray, segments: np.ndarray, w: Weights, *, how: str = "pooler", **options) -> np.ndarray:
    """The task head of pair classification: an encoder over both texts as one sequence, pooled, and a dense layer with softmax."""
    _, states = transformer(ids, segments, w, **options)
    return softmax(dense(pooled(states, (ids != 0).astype(float), w, how), w, "head"))


def conv1d(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray, stride: int = 1, same: bool = False) -> np.ndarray:
    """[batch, length, channels] with [width, channels, filters]."""
    width = len(kernel)
    if same:
        x = np.pad(x, ((0, 0), ((width - 1) // 2, width // 2), (0, 0)))
    windows = np.lib.stride_tricks.sliding_window_view(x, width, axis=1)[:, ::stride]
    return np.einsum("blcw,wcf->blf", windows, kernel) + bias


def text_cnn(x: np.ndarray, w: Weights, widths: tuple[int, ...]) -> np.ndarray:
    """The greatest response over time of each filter, all widths side by side."""
    return np.concatenate([np.maximum(conv1d(x, w[f"conv{k}.w"], w[f"conv{k}.b"]), 0).max(1) for k in widths], -1)


def fast_text(x: np.ndarray, w: Weights, act: str = "relu") -> np.ndarray:
    return softmax(dense(activation(act)(dense(np.concatenate([x.max(1), x.mean(1)], -1), w, "hidden")), w, "out"))


def highway(x: np.ndarray, w: Weights, layers: int) -> np.ndarray:
    for k in range(layers):
        gate = sigmoid(dense(x, w, f"gate{k}"))
        x = gate * np.maximum(dense(x, w, f"carry{k}"), 0) + (1 - gate) * x
    return x


def batch_norm(x: np.ndarray, w: Weights, name: str, eps: float = 1e-3) -> np.ndarray:
    return (x - w[f"{name}.mean"]) / np.sqrt(w[f"{name}.var"] + eps) * w[f"{name}.g"] + w[f"{name}.beta"]


def k_max(x: np.ndarray, k: int) -> np.ndarray:
    """The k greatest values of each channel over time, in their order in time."""
    at = np.sort(np.argsort(-x, axis=1, kind="stable")[:, :k], axis=1)
    return np.take_along_axis(x, at, 1)


def conv_block(x: np.ndarray, w: Weights, name: str, shortcut: bool = True) -> np.ndarray:
    """Two normalised convolutions, with a shortcut where the widths agree or a projection is given."""
    y = x
    for k in (1, 2):
        y = np.maximum(batch_norm(conv1d(y, w[f"{name}.c{k}.w"], w[f"{name}.c{k}.b"], same=True), w, f"{name}.n{k}"), 0)
    if shortcut:
        y = y + (conv1d(x, w[f"{name}.s.w"], w[f"{name}.s.b"]) if f"{name}.s.w" in w else x)
    return y


def halved(x: np.ndarray) -> np.ndarray:
    """Max pooling of width 3 and stride 2."""
    padded = np.pad(x, ((0, 0), (1, 1), (0, 0)), constant_values=-np.inf)
    return np.lib.stride_tricks.sliding_window_view(padded, 3, axis=1)[:, ::2].max(-1)


def lstm(x: np.ndarray, w: Weights, name: str, backwards: bool = False) -> np.ndarray:
    h = c = np.zeros((len(x), w[f"{name}.u"].shape[0]))
    out = []
    for t in range(x.shape[1] - 1, -1, -1) if backwards else range(x.shape[1]):
        i, f, g, o = np.split(x[:, t] @ w[f"{name}.w"] + h @ w[f"{name}.u"] + w[f"{name}.b"], 4, -1)
        c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
        h = sigmoid(o) * np.tanh(c)
        out.append(h)
    return np.stack(out[::-1] if backwards else out, 1)


def gru(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    h = np.zeros((len(x), w[f"{name}.u"].shape[0]))
    out = []
    for t in range(x.shape[1]):
        a, b = x[:, t] @ w[f"{name}.w"] + w[f"{name}.b"], h @ w[f"{name}.u"]
        (az, ar, an), (bz, br, bn) = np.split(a, 3, -1), np.split(b, 3, -1)
        z, r = sigmoid(az + bz), sigmoid(ar + br)
        h = z * h + (1 - z) * np.tanh(an + r * bn)
        out.append(h)
    return np.stack(out, 1)


def char_cnn(x: np.ndarray, w: Weights, widths: tuple[int, ...], layers: int = 2) -> np.ndarray:
    """Convolutions, normalisation, highway and a two-way LSTM, as [batch, 2 h]."""
    y = highway(batch_norm(text_cnn(x, w, widths), w, "norm"), w, layers)[:, None]
    return np.concatenate([lstm(y, w, "forward")[:, -1], lstm(y, w, "backward", True)[:, 0]], -1)


def deep_cnn(x: np.ndarray, w: Weights, blocks: int, k: int) -> np.ndarray:
    """Stacked convolution blocks, each but the last halved in length, and k-max pooling."""
    x = conv1d(x, w["first.w"], w["first.b"], same=True)
    for n in range(blocks):
        x = conv_block(x, w, f"cb{n}")
        if n < blocks - 1:
            x = halved(x)
    return k_max(x, min(k, x.shape[1])).reshape(len(x), -1)


def cosine(a: np.ndarray, b: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    return (a * b).sum(-1) / np.maximum(np.linalg.norm(a, axis=-1) * np.linalg.norm(b, axis=-1), eps)


def siamese(a: np.ndarray, b: np.ndarray, encode: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    return cosine(encode(a), encode(b))


def birnn(x: np.ndarray, w: Weights) -> np.ndarray:
    """The mean over time of a two-way LSTM."""
    return np.concatenate([lstm(x, w, "forward"), lstm(x, w, "backward", True)], -1).mean(1)


def late_interaction(q: np.ndarray, d: np.ndarray, q_mask: np.ndarray, d_mask: np.ndarray, metric: str = "cosine") -> np.ndarray:
    if metric == "cosine":
        q, d = (x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12) for x in (q, d))
        s = q @ np.swapaxes(d, -1, -2)
    else:
        s = -((q[:, :, None] - d[:, None]) ** 2).sum(-1)
    s = np.where(d_mask[:, None] > 0, s, -1e9).max(-1)
    return (s * q_mask).sum(-1)


def poly_encoder(context: np.ndarray, candidate: np.ndarray, mask: np.ndarray, w: Weights) -> np.ndarray:
    """Codes attend to the context, the candidate's vector attends to the codes."""
    codes = np.broadcast_to(w["codes"], (len(context), *w["codes"].shape))
    seen = attention(codes[:, None], context[:, None], context[:, None], mask)[:, 0]
    met = attention(candidate[:, None, None], seen[:, None], seen[:, None])[:, 0, 0]
    return (met * candidate).sum(-1)


def alignment(a: np.ndarray, b: np.ndarray, a_mask: np.ndarray, b_mask: np.ndarray, w: Weights, name: str) -> tuple[np.ndarray, np.ndarray]:
    s = gelu(dense(a, w, f"{name}.p")) @ np.swapaxes(gelu(dense(b, w, f"{name}.p")), -1, -2)
    s = np.where((a_mask[:, :, None] * b_mask[:, None, :]) > 0, s, -1e9)
    return softmax(s, 2) @ b, np.swapaxes(softmax(s, 1), 1, 2) @ a


def fusion(x: np.ndarray, y: np.ndarray, w: Weights, name: str) -> np.ndarray:
    parts = [np.concatenate(p, -1) for p in ((x, y), (x, x - y), (x, x * y))]
    return gelu(dense(np.concatenate([gelu(dense(p, w, f"{name}.f{k}")) for k, p in enumerate(parts)], -1), w, f"{name}.f"))


def re2(a: np.ndarray, b: np.ndarray, a_mask: np.ndarray, b_mask: np.ndarray, w: Weights, blocks: int) -> np.ndarray:
    """Blocks of convolution, alignment and fusion with augmented residuals, max pooling over tokens, a symmetric prediction."""
    def encode(x, mask, n):
        return np.maximum(conv1d(x * mask[..., None], w[f"re{n}.c.w"], w[f"re{n}.c.b"], same=True), 0)

    first, last = (a, b), (a, b)
    for n in range(blocks):
        if n:
            last = tuple(np.concatenate([f, (x + y) / np.sqrt(2) if n > 1 else x], -1) for f, x, y in zip(first, last, prior))
        x = [np.concatenate([s, encode(s, m, n)], -1) for s, m in zip(last, (a_mask, b_mask))]
        to_a, to_b = alignment(*x, a_mask, b_mask, w, f"re{n}")
        prior = last = tuple(fusion(s, t, w, f"re{n}") for s, t in zip(x, (to_a, to_b)))
    p, q = (np.where(m[..., None] > 0, s, -1e9).max(1) for s, m in zip(last, (a_mask, b_mask)))
    return dense(gelu(dense(np.concatenate([p, q, np.abs(p - q), p * q], -1), w, "re.h")), w, "re.out")


def resized(a: np.ndarray, shape: tuple[int, ...], window: int = 2) -> np.ndarray:
    """A weight matrix in another shape of the same norm: along each axis that grows, every `window` neighbours are repeated as a group until the
    new size is reached; an axis that shrinks is cut."""
    take = []
    for old, new in zip(a.shape, shape):
        times = -(-new // old)
        if times > 1 and old % window:
            raise ValueError(f"{old} rows are no groups of {window}")
        at = np.arange(new)
        take.append(at // (window * times) * window + at % window if times > 1 else at)
    out = a[np.ix_(*take)]
    return out * (np.linalg.norm(a) / np.linalg.norm(out))


def random_transformer(*, vocab: int, size: int, layers: int, hidden: int, length: int, seed: int = 1) -> Weights:
    """Weights for tests and shape checks."""
    draw = np.random.default_rng(seed)
    matrix = lambda *shape: draw.normal(0, 0.05, shape)
    w = {"token": matrix(vocab, size), "segment": matrix(2, size), "position": matrix(length, size), "embed.g": np.ones(size), "embed.beta": np.zeros(size), "pooler.w": matrix(size, size), "pooler.b": np.zeros(size)}
    for k in range(layers):
        for part, (i, o) in {"q": (size, size), "k": (size, size), "v": (size, size), "o": (size, size), "in": (size, hidden), "out": (hidden, size)}.items():
            w[f"block{k}.{part}.w"], w[f"block{k}.{part}.b"] = matrix(i, o), np.zeros(o)
        w |= {f"block{k}.g1": np.ones(size), f"block{k}.g2": np.ones(size), f"block{k}.b1": np.zeros(size), f"block{k}.b2": np.zeros(size)}
    return w


def padded(rows: np.ndarray, values: np.ndarray, n: int, length: int | None = None) -> np.ndarray:
    """[n, length] of ids in row order, by default as wide as the longest row; what is beyond a given `length` is cut."""
    first = np.searchsorted(rows, np.arange(n + 1))
    length = max(1, int(np.diff(first).max(initial=1))) if length is None else length
    out = np.zeros((n, length), np.int64)
    pos = np.arange(len(rows)) - first[rows]
    inside = pos < length
    out[rows[inside], pos[inside]] = values[inside]
    return out


def siamese_scores(pairs: DataFrame, id_col: str, a: str = "text_a", b: str = "text_b", weights: Weights | None = None, *, layers: int = 2, heads: int = 2, window: int = 64, vocab: int = 2000) -> DataFrame:
    """(id, score): the cosine of the two texts' encodings, by weights that are sent once to every executor. Texts are read whole: each is
    encoded in windows of `window` tokens, whose pooled states are averaged, weighted by their tokens. Token ids are hashed into
    the vocabulary; null texts encode as empty ones."""
    weights = weights or random_transformer(vocab=vocab, size=32, layers=layers, hidden=64, length=window)
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            sides = []
            for column in batch.columns[1:]:
                t = tokens(column)
                n = np.bincount(t.row, minlength=batch.num_rows)
                windows = np.maximum(1, -(-n // window))  # of each text
                first = np.cumsum(windows) - windows
                pos = np.arange(len(t.row)) - (np.cumsum(n) - n)[t.row]
                width = min(window, max(1, int(n.max(initial=1))))
                ids = padded(first[t.row] + pos // window, (t.hash % np.uint64(vocab - 1)).astype(np.int64) + 1, int(windows.sum()), width)
                parts = []
                for at in range(0, len(ids), 512):
                    part = ids[at : at + 512]
                    _, states = transformer(part, np.zeros_like(part), w, layers=layers, heads=heads)
                    held = (part != 0).astype(float)
                    parts.append(pooled(states, held, w, "last-avg") * np.maximum(held.sum(1), 1)[:, None])
                sums = np.add.reduceat(np.concatenate(parts), first) if parts else np.zeros((0, 1))
                sides.append(sums / np.maximum(n, 1)[:, None])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cosine(*sides))], ["id", "score"])

    kind = pairs.schema[id_col].dataType.simpleString()
    return pairs.select(id_col, a, b).mapInArrow(run, f"id {kind}, score double")
