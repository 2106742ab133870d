"""Language-model scores from a causal self-attention model in numpy.

Texts are taken as lower-cased words; each word becomes subword ids of `byte_bpe_50k`, and an end mark closes the text. The
score is the sum of the log probabilities that the attention model gives the ids, the end mark included, so it is the log
probability of the text's id sequence; nothing else is mixed in.

The model is one attention layer with learned distance biases over embeddings of an id and the id before it, and a
feed-forward layer. Its softmax has two steps, class and id within the class, over the IDS most frequent subwords; all others
share the id RARE, followed by a choice among them by their corpus frequency, so that the probabilities of all subwords of
the vocabulary sum to one. A text's ids are cut into blocks of BLOCK; the context window of a block is the block and the one
before it (64 ids), so windows overlap by half and every id is scored once, in batches under the causal mask.

Learning covers every training text: word and subword counts are taken over all of them. The parameters start from a
sample of START_WINDOWS windows at most (their initial value only) and are then refined on windows of all training texts,
each task on its own, at most MODELS of them, the parameters being averaged by a distributed aggregate. The refinement
predicts every id of every training text once: STRIDE is 1. A larger one would predict one block in STRIDE, from an offset
that differs from text to text.

Texts are tokenised once, into a table of ids in the shared folder that both learning and scoring read. What is sent to the
workers is bounded: the HOT_WORDS most frequent words' counts for the base score, the vocabulary and the parameters. Words
beyond those get their counts by a join on the word, with a text's counts combined before.

Defined cases: a null text is the empty text, one end mark. Null and repeated ids are scored row by row. Without training
texts all counts are zero (N = V = 0) and the scores come from the untrained model. Empty tables give empty results. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import ctypes
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelore.llm.packing import ids_of, vocabulary_path
from voxelore.llm.store import written

FOLDS, HOT_WORDS, START_WINDOWS, START_EPOCHS, STRIDE, MODELS = 10, 150_000, 48_000, 3, 1, 4096
IDS, CLASS, DIM, WIDE, BLOCK = 4096, 64, 24, 48, 32
RARE, END, PAD = 0, 1, 65_535
RATE, REFINE_RATE, STEP_WINDOWS, SHUFFLED = 6e-3, 1.5e-3, 256, 8192
#: Blocks scored at once, ids laid out at once, bytes of text counted and numbered at once, words remembered.
AT_ONCE, LAID_OUT, COUNTED, NUMBERED_AT_ONCE, MEMO = 128, 200_000, 16_000_000, 2_000_000, 400_000
#: Rows of one product and windows of one part of a step: sized for the processor's caches, neither changes what is computed.
PIECE, WINDOWS_AT_ONCE = 256, 128
LN10 = float(np.log(10))
_f4 = np.float32


def subwords(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of each word with a space before it, one word after another, and how many each has."""
    known = ids_of(path)
    parts = [" " + w.decode("utf-8", "replace") for w in words]
    flat = known.encoding.encode_to_numpy("".join(parts), disallowed_special=()).astype(np.int64)
    at = np.flatnonzero(known.opens[flat])
    if len(at) == len(parts):  # words hold no spaces, so each has one token with a leading space, its first
        return flat, np.diff(at, append=len(flat))
    each = [known.encode(x) for x in parts]
    return np.array(list(chain.from_iterable(each)), np.int64), np.array([len(x) for x in each], np.int64)


@lru_cache(maxsize=1)
def _keep_memory() -> None:
    """Has the allocator keep freed arrays: otherwise each batch pays for fresh pages, which costs more than the sums."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 26)
        libc.mallopt(-1, 1 << 27)


@dataclass
class Vocabulary:
    """By subword id: the model id, and the log probability of what the id RARE leaves open (0 for others)."""

    model_ids: np.ndarray
    left_open: np.ndarray
    counts: np.ndarray  # by model id, without the end mark

    @classmethod
    def of(cls, counts: np.ndarray) -> Vocabulary:
        order = np.lexsort((np.arange(len(counts)), -counts))
        own, rest = order[: IDS - 2], order[IDS - 2 :]
        ids, left = np.full(len(counts), RARE, np.int64), np.zeros(len(counts))
        ids[own] = np.arange(2, 2 + len(own))
        left[rest] = np.log((counts[rest] + 1) / (counts[rest].sum() + len(rest))) if len(rest) else 0
        by_id = np.zeros(IDS, np.int64)
        by_id[2 : 2 + len(own)] = counts[own]
        by_id[RARE] = counts[rest].sum()
        return cls(ids, left, by_id)


# The model


def new_params(counts: np.ndarray | None = None, seed: int = 5) -> dict[str, np.ndarray]:
    """Random weights; the output biases start from the ids' frequencies."""
    rng = np.random.default_rng(seed)
    n = lambda *s, k: rng.normal(0, k, s).astype(_f4)
    log_n = np.log((np.zeros(IDS) if counts is None else counts) + 0.5).reshape(-1, CLASS)
    in_class = np.log(np.exp(log_n).sum(axis=1))
    return {
        "E": n(IDS, DIM, k=0.1), "P": n(IDS, DIM, k=0.1), "q": n(DIM, DIM, k=0.2), "kv": n(DIM, 2 * DIM, k=0.2), "R": np.zeros((BLOCK, 2 * BLOCK), _f4),
        "o": n(DIM, DIM, k=0.1), "w1": n(DIM, WIDE, k=0.2), "b1": np.zeros(WIDE, _f4), "w2": n(WIDE, DIM, k=0.1),
        "c": n(DIM, IDS // CLASS, k=0.1), "bc": (in_class - in_class.mean()).astype(_f4),
        "t": n(IDS, DIM, k=0.1), "bt": (log_n - log_n.mean(axis=1, keepdims=True)).astype(_f4).ravel(),
    }


_CAUSAL = np.where(np.arange(2 * BLOCK)[None, :] <= np.arange(BLOCK)[:, None] + BLOCK, 0, -1e9).astype(_f4)


def _times(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """a @ b, PIECE rows at a time: the BLAS multiplies small matrices without copying them first."""
    out = np.empty((len(a), b.shape[1]), a.dtype) if out is None else out
    whole = len(a) - len(a) % PIECE
    np.matmul(a[:whole].reshape(-1, PIECE, a.shape[1]), b, out=out[:whole].reshape(-1, PIECE, b.shape[1]))
    np.matmul(a[whole:], b, out=out[whole:])
    return out


def _over_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, likewise."""
    whole = len(a) - len(a) % PIECE
    out = np.matmul(a[:whole].reshape(-1, PIECE, a.shape[1]).transpose(0, 2, 1), b[:whole].reshape(-1, PIECE, b.shape[1])).sum(axis=0)
    out += a[whole:].T @ b[whole:]
    return out


def _weigh(p: dict, q: np.ndarray, kk: np.ndarray, v1: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attention of blocks q (n, BLOCK, DIM) to windows: exponentials, 1 / their sums, and the weighed values. v1: values and a 1, which gives the sums."""
    s = np.matmul(q, kk.transpose(0, 2, 1))
    s += p["R"] + _CAUSAL
    s[first, :, :BLOCK] = -1e9
    if s.max(initial=0) > 60:
        np.minimum(s, 60, out=s)
    np.exp(s, out=s)
    z1 = np.matmul(s, v1).reshape(-1, DIM + 1)
    per = 1 / z1[:, DIM:]
    return s, per, z1[:, :DIM] * per


def _after(p: dict, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feed-forward layer's hidden values, and the hidden states with a 1 as their last value."""
    f = _times(h, p["w1"])
    f += p["b1"]
    np.maximum(f, 0, out=f)
    g1 = np.empty((len(h), DIM + 1), h.dtype)
    np.add(h, f @ p["w2"], out=g1[:, :DIM])
    g1[:, DIM] = 1
    return f, g1


def _states(p: dict, x: np.ndarray, before: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hidden states, and a 1 each, of consecutive blocks x (n, BLOCK); before: the ids before these; first: the block opens its text."""
    n = len(x)
    e = p["E"].take(x.ravel(), axis=0)
    e += p["P"].take(before.ravel(), axis=0)
    # Keys, values (here already through the output matrix) and ones after one empty block: windows are overlapping views of them.
    kv1 = np.empty(((n + 1) * BLOCK, 2 * DIM + 1), e.dtype)
    kv1[:BLOCK] = 0
    _times(e, np.concatenate([p["kv"][:, :DIM], p["kv"][:, DIM:] @ p["o"]], axis=1), kv1[BLOCK:, : 2 * DIM])
    kv1[:, 2 * DIM] = 1
    both = np.lib.stride_tricks.as_strided(kv1, (n, 2 * BLOCK, 2 * DIM + 1), (BLOCK * kv1.strides[0], *kv1.strides))
    h = _weigh(p, (e @ (p["q"] * _f4(DIM**-0.5))).reshape(n, BLOCK, DIM), both[..., :DIM], both[..., DIM:], first)[2]
    h += e
    return _after(p, h)[1]


def _outputs(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """The output weights of classes and ids with their biases, which a state's last value, 1, brings in."""
    return np.concatenate([p["c"], p["bc"][None]]), np.concatenate([p["t"], p["bt"][:, None]], axis=1)


def _softmax(fill, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log softmax at one place of each row of what fill() gives, the exponentials and the rows' sums of them."""
    z = fill()
    picked, ones = z[np.arange(len(z)), at], np.ones(z.shape[1], z.dtype)
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
        total = z @ ones
    if len(z) and not (total.min() > 1e-30 and total.max() < 1e30):  # near the end of float32's range
        z = fill()
        shift = z.max(axis=1)
        z -= shift[:, None]
        picked -= shift
        np.exp(z, out=z)
        total = z @ ones
    return picked - np.log(total), z, total


def _by_class(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice, slice]]]:
    """The order of y by class, its classes in that order, and (class, rows, ids) of each class that occurs."""
    order = np.argsort((y // CLASS).astype(np.uint8), kind="stable")
    kind = y[order] // CLASS
    ends = np.searchsorted(kind, np.arange(IDS // CLASS + 1)).tolist()
    runs = [(c, slice(ends[c], ends[c + 1]), slice(c * CLASS, (c + 1) * CLASS)) for c in range(IDS // CLASS) if ends[c] < ends[c + 1]]
    return order, kind, runs


def _classes(g1: np.ndarray, c1: np.ndarray):
    return lambda: _times(g1, c1)


def _members(g1: np.ndarray, t1: np.ndarray, runs: list, z: np.ndarray):
    """Fills z, whose rows are sorted by class, with the outputs of the ids of each row's class."""

    def fill() -> np.ndarray:
        for _, rows, ids in runs:
            np.matmul(g1[rows], t1[ids].T, out=z[rows])
        return z

    return fill


def _pick(c1: np.ndarray, t1: np.ndarray, g1: np.ndarray, places: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of id y after the hidden state at each place."""
    order, kind, runs = _by_class(y)
    g1 = g1.take(places[order], axis=0)
    lp, z, _ = _softmax(_classes(g1, c1), kind)
    lp += _softmax(_members(g1, t1, runs, z), y[order] - kind * CLASS)[0]
    out = np.empty(len(y), lp.dtype)
    out[order] = lp
    return out


def log_probs(p: dict, x: np.ndarray, before: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of each id of y (flat, -1: padding, gives 0) after the ids of x, AT_ONCE blocks at a time."""
    out = np.zeros(len(y), p["E"].dtype)
    outputs = _outputs(p)
    for at in range(0, len(x), AT_ONCE):
        lo = max(0, at - 1)  # windows reach one block back
        g1 = _states(p, x[lo : at + AT_ONCE], before[lo : at + AT_ONCE], first[lo : at + AT_ONCE])
        part = y[at * BLOCK : (at + AT_ONCE) * BLOCK]
        real = np.flatnonzero(part >= 0)
        out[at * BLOCK + real] = _pick(*outputs, g1, (at - lo) * BLOCK + real, part[real])
    return out


def _gradients(p: dict, w: np.ndarray, first: np.ndarray) -> tuple[float, int, dict[str, np.ndarray]]:
    """Loss, number of targets and the loss's gradients over windows w (see `windows`), summed over parts that fit the processor's cache."""
    loss, n, d = _part_gradients(p, w[:WINDOWS_AT_ONCE], first[:WINDOWS_AT_ONCE])
    for at in range(WINDOWS_AT_ONCE, len(w), WINDOWS_AT_ONCE):
        more, m, other = _part_gradients(p, w[at : at + WINDOWS_AT_ONCE], first[at : at + WINDOWS_AT_ONCE])
        loss, n = loss + more, n + m
        for k, x in other.items():
            d[k] += x
    return loss, n, d


def _part_gradients(p: dict, w: np.ndarray, first: np.ndarray) -> tuple[float, int, dict[str, np.ndarray]]:
    n, y = len(w), w[:, 2 + BLOCK :].ravel()
    ids = np.where(w == PAD, RARE, w)
    x, before = ids[:, 1:-1].ravel(), ids[:, :-2].ravel()
    e = p["E"].take(x, axis=0)
    e += p["P"].take(before, axis=0)
    kv1 = np.empty((len(e), 2 * DIM + 1), e.dtype)
    _times(e, p["kv"], kv1[:, : 2 * DIM])
    kv1[:, 2 * DIM] = 1
    kv1 = kv1.reshape(n, 2 * BLOCK, -1)
    kk, v1 = kv1[..., :DIM], kv1[..., DIM:]
    own = np.ascontiguousarray(e.reshape(n, 2 * BLOCK, DIM)[:, BLOCK:]).reshape(-1, DIM)
    scale = _f4(DIM**-0.5)
    q = (own @ (p["q"] * scale)).reshape(n, BLOCK, DIM)
    s, per, z = _weigh(p, q, kk, v1, first)
    h = z @ p["o"]
    h += own
    f, g1 = _after(p, h)

    real = np.flatnonzero(y != PAD)
    order, kind, runs = _by_class(y[real])
    order = real[order]
    g1, at, rows_of = g1.take(order, axis=0), y[order] - kind * CLASS, np.arange(len(order))
    c1, t1 = _outputs(p)
    # An output's gradient is a / total once total is taken from the target's a; each row's 1 / total goes into what a is multiplied with.
    lp, a, total = _softmax(_classes(g1, c1), kind)
    loss = -lp.sum(dtype=np.float64)
    a[rows_of, kind] -= total
    part = (1 / total)[:, None]
    dc1 = _over_rows(g1 * part, a)
    dg = a @ p["c"].T
    dg *= part
    lp, a, total = _softmax(_members(g1, t1, runs, a), at)
    loss -= lp.sum(dtype=np.float64)
    a[rows_of, at] -= total
    part = (1 / total)[:, None]
    g1 *= part
    dt1, inner = np.zeros_like(t1), np.empty_like(dg)
    for _, rows, members in runs:
        np.matmul(a[rows].T, g1[rows], out=dt1[members])
        np.matmul(a[rows], p["t"][members], out=inner[rows])
    inner *= part
    dg += inner
    d = {"c": dc1[:DIM], "bc": dc1[DIM], "t": dt1[:, :DIM], "bt": dt1[:, DIM]}

    full = np.zeros_like(h)
    full[order] = dg
    df = _times(full, p["w2"].T)
    df *= f > 0
    d["w2"], d["w1"], d["b1"] = _over_rows(f, full), _over_rows(h, df), np.ones(len(df), df.dtype) @ df
    dh = df @ p["w1"].T
    dh += full
    d["o"] = _over_rows(z, dh)
    # Of the weights s * per: their gradient's mean under the weights is dz . z, which the ones of v1 take off.
    dz1 = np.empty((len(z), DIM + 1), z.dtype)
    dz = dz1[:, :DIM]
    np.matmul(dh, p["o"].T, out=dz)
    dz *= per
    np.einsum("ij,ij->i", dz, z, out=dz1[:, DIM])
    np.negative(dz1[:, DIM], out=dz1[:, DIM])
    dz1 = dz1.reshape(n, BLOCK, DIM + 1)
    ds = np.matmul(dz1, v1.transpose(0, 2, 1))
    ds *= s
    d["R"] = ds.sum(axis=0)
    dkv = np.empty((n, 2 * BLOCK, 2 * DIM), e.dtype)
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :DIM])
    np.matmul(s.transpose(0, 2, 1), dz1[..., :DIM], out=dkv[..., DIM:])
    dkv = dkv.reshape(-1, 2 * DIM)
    dq = np.matmul(ds, kk).reshape(-1, DIM)
    d["q"], d["kv"] = _over_rows(own, dq) * scale, _over_rows(e, dkv)
    dh += dq @ (p["q"] * scale).T
    de = dkv @ p["kv"].T
    de.reshape(n, 2 * BLOCK, DIM)[:, BLOCK:] += dh.reshape(n, BLOCK, DIM)
    pairs = np.result_type(de, np.complex64)  # two values are added as one complex number
    for name, at in (("E", x), ("P", before)):
        place = np.argsort(at.astype(np.uint16), kind="stable")
        at = at[place]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        d[name] = np.zeros_like(p[name])
        d[name].view(pairs)[at[starts]] = np.add.reduceat(de.view(pairs).take(place, axis=0), starts, axis=0)
    return float(loss), len(order), d


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.step = p, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def update(self, d: dict[str, np.ndarray], n: int, rate: float) -> None:
        self.step += 1
        rate, grown = _f4(rate / (1 - 0.9**self.step)), _f4((1 - 0.99**self.step) ** -0.5)
        for k, g in d.items():
            m, v = self.m[k], self.v[k]
            g = g * _f4(0.1 / n)
            m *= _f4(0.9)
            m += g
            v *= _f4(0.99)
            g *= g
            v += g
            root = np.sqrt(v)
            root += _f4(1e-6) / grown
            np.divide(m, root, out=root)
            root *= rate / grown
            self.p[k] -= root


# Texts as blocks and windows


def blocks_of(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, before, first, y, places) of joined id sequences: blocks of what precedes each id, and y with padding -1; places: where each id stands in y."""
    n_blocks = np.maximum(1, -(-size // BLOCK))
    base = (np.cumsum(n_blocks) - n_blocks) * BLOCK
    total = int(n_blocks.sum()) * BLOCK
    places = np.repeat(base - (np.cumsum(size) - size), size) + np.arange(len(flat))
    y = np.full(total, -1, np.int64)
    y[places] = flat
    x, before = np.full(total, END, np.int64), np.full(total, END, np.int64)
    x[1:] = np.maximum(y[:-1], RARE)
    x[base] = END
    before[1:] = x[:-1]
    before[base] = END
    first = np.zeros(total // BLOCK, bool)
    first[base // BLOCK] = True
    return x.reshape(-1, BLOCK), before.reshape(-1, BLOCK), first, y, places


def windows(flat: np.ndarray, size: np.ndarray, chosen) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the chosen blocks and whether each opens its text.

    A window is the 34 ids before a block and the block's own: an id before the first, 64 that are read, of which the
    last 32 predict their successors, and a last one. chosen: text numbers and block numbers within -> mask.
    """
    _, _, first, y, _ = blocks_of(flat, size)
    n_blocks = np.maximum(1, -(-size // BLOCK))
    text = np.repeat(np.arange(len(size)), n_blocks)
    number = np.arange(len(first)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    keep = np.flatnonzero(chosen(text, number))
    long = np.concatenate([np.full(BLOCK + 2, END, np.int64), y])
    w = long[keep[:, None] * BLOCK + np.arange(2 * BLOCK + 2)]
    w[w < 0] = PAD
    w[number[keep] == 0, : BLOCK + 2] = END
    w[number[keep] == 1, :2] = END
    return w, first[keep]


def fit(p: dict, w: np.ndarray, first: np.ndarray, epochs: int, rate: float, seed: int = 3) -> dict:
    """Adam over shuffled batches of windows, at a falling rate."""
    _keep_memory()
    rng, adam, done = np.random.default_rng(seed), Adam({k: v.copy() for k, v in p.items()}), 0
    steps = max(1, epochs * -(-len(w) // STEP_WINDOWS))
    for _ in range(epochs):
        order = rng.permutation(len(w))
        for at in range(0, len(order), STEP_WINDOWS):
            part = order[at : at + STEP_WINDOWS]
            _, n, d = _gradients(adam.p, w[part].astype(np.int64), first[part])
            adam.update(d, max(n, 1), rate * (1 - 0.9 * done / steps))
            done += 1
    return adam.p

# Tokenising


def _training(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS != 0


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, one text after another, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)  # a blank at an end leaves an empty part; each text has one part at least
    n = np.add.reduceat(real.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()) if len(texts) else np.zeros(0, np.int64)
    return flat.filter(real), n


def _sizes(texts: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the training texts; the end mark is the empty word."""
    for batch in batches:
        texts = batch.column(1).filter(pa.array([_training(x) for x in batch.column(0).to_pylist()], pa.bool_()))
        for part in _runs(_sizes(texts), COUNTED):
            own = texts.slice(part.start, part.stop - part.start)
            found = words_in(own)[0].value_counts()
            words = pa.concat_arrays([found.field("values").cast(pa.binary()), pa.array([b""], pa.binary())])
            yield pa.RecordBatch.from_arrays([words, pa.concat_arrays([found.field("counts"), pa.array([len(own)], pa.int64())])], ["word", "n"])


def _count_subwords(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ids_of(path).encoding.n_vocab, np.int64)
        for batch in batches:
            pairs = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if w]
            flat, size = subwords(path, [w for w, _ in pairs])
            np.add.at(counts, flat, np.repeat(np.array([n for _, n in pairs], np.int64), size))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found], pa.int64())], ["t", "n"])

    return count


class Words(dict):
    """Numbers of words seen, up to a bound, with arrays of their model ids, what the id RARE leaves open and their count.

    Number 0 is the end mark.
    """

    def __init__(self, path: str, vocabulary: Vocabulary, hot: dict[bytes, int]):
        super().__init__()
        self.path, self.hot, self.vocabulary = path, hot, vocabulary
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.ids, self.start, self.size = np.zeros(1 << 16, np.uint16), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.rest, self.count = np.zeros(1 << 14), np.zeros(1 << 14)
        self.used = 0
        self._add([b""], np.array([END]), np.ones(1, np.int64), np.zeros(1))

    def _add(self, words: list[bytes], ids: np.ndarray, size: np.ndarray, rest: np.ndarray) -> None:
        a, b = len(self), len(self) + len(words)
        while b > len(self.start):
            for name in ("start", "size", "rest", "count"):
                setattr(self, name, np.concatenate([old := getattr(self, name), np.zeros_like(old)]))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[a:b], self.size[a:b], self.rest[a:b] = self.used + np.cumsum(size) - size, size, rest
        self.count[a:b] = [self.hot.get(w, 0) for w in words]
        self.used += len(ids)
        self.update(zip(words, range(a, b), strict=True))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct words."""
        if len(self) + len(words) > MEMO and len(self) > 1:
            self.reset()
        if new := [w for w in words if w not in self]:
            flat, size = subwords(self.path, new)
            self._add(new, self.vocabulary.model_ids[flat], size, np.add.reduceat(self.vocabulary.left_open[flat], np.cumsum(size) - size))
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def tokens(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Their model ids one after another, and how many each has."""
        size = self.size[numbers]
        at = np.repeat(self.start[numbers] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.ids[at], size


NUMBERED = "row long, doc_id long, trained boolean, n_tokens long, n_ids long, ids binary, left_open double, n_hot long, base_hot double, tail array<struct<word: binary, n: long>>"
_NUMBERED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary()), ("left_open", pa.float64())]
    + [("n_hot", pa.int64()), ("base_hot", pa.float64()), ("tail", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))]
)


def _runs(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive rows of about `most` together, one row at least."""
    at = 0
    while at < len(sizes):
        upto, total = at + 1, sizes[at]
        while upto < len(sizes) and total + sizes[upto] <= most:
            total, upto = total + sizes[upto], upto + 1
        yield slice(at, upto)
        at = upto


def _binaries(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary value of each run of numbers."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32) * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _number(shared):
    """Texts (doc_id, text, id) as model ids, with the base score's part of the hot words and the other words' counts."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, vocabulary, hot = shared.value
        known, row = Words(path, vocabulary, hot), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in _runs(_sizes(batch.column(1)), NUMBERED_AT_ONCE):
                docs, texts, keys = (c.slice(part.start, part.stop - part.start) for c in batch.columns)
                words, n_words = words_in(texts)
                coded, n = words.dictionary_encode(), len(texts)
                distinct = coded.dictionary.cast(pa.binary())
                place = coded.indices.to_numpy()
                ends = np.cumsum(n_words)
                # A text's words and its end mark, number 0; places of the distinct words likewise, the end mark's last.
                own = np.insert(place, ends, len(distinct))
                by_place = np.append(known.numbers(distinct.to_pylist()), 0)
                starts, numbers = ends - n_words + np.arange(n), by_place[own]
                ids, size = known.tokens(numbers)
                n_ids, counts = np.add.reduceat(size, starts), known.count[numbers]
                cold = np.flatnonzero(counts == 0)
                pairs, n_pairs = np.unique((np.searchsorted(starts, cold, side="right") - 1) * (len(distinct) + 1) + own[cold], return_counts=True)
                tail = pa.StructArray.from_arrays([pa.concat_arrays([distinct, pa.array([b""], pa.binary())]).take(pa.array(pairs % (len(distinct) + 1))), pa.array(n_pairs, pa.int64())], ["word", "n"])
                offsets = np.searchsorted(pairs, np.arange(n + 1) * (len(distinct) + 1)).astype(np.int32)
                cols = [
                    pa.array(range(row, row + n)), docs, pa.array([_training(x) for x in keys.to_pylist()], pa.bool_()), pa.array(n_words + 1), pa.array(n_ids),
                    _binaries(ids.astype("<u2"), n_ids), pa.array(np.add.reduceat(known.rest[numbers], starts)), pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                    pa.array(np.add.reduceat(np.where(counts > 0, np.log10(counts + 0.1), 0.0), starts)), pa.ListArray.from_arrays(pa.array(offsets), tail),
                ]
                row += n
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, _NUMBERED, strict=True)], schema=_NUMBERED)

    return number


# Learning


def _ids(rows: pa.Array, part: slice) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some rows of a binary column, one after another, and how many each has."""
    offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset + part.start : rows.offset + part.stop + 1].astype(np.int64)
    raw = np.frombuffer(rows.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0])
    return raw.view("<u2").astype(np.int64), np.diff(offsets) // 2


def _id_counts(rows: pa.Array) -> list[int]:
    return pc.divide(pc.binary_length(rows), 2).to_pylist()


def _mixed_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 32-bit hash of pairs of numbers."""
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(32)


def _sample(share: float):
    """Windows (row, ids) of a share of all blocks, by a hash of the row and the block's number."""
    limit = np.uint64(min(share, 1.0) * 2**32)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for part in _runs(_id_counts(batch.column(1)), LAID_OUT):
                own = rows[part]
                w, first = windows(*_ids(batch.column(1), part), lambda text, block: _mixed_bits(own[text], block) < limit)  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<u2").tobytes() for x in w], pa.binary()), pa.array(first, pa.bool_())], ["w", "first"])

    return sample


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(_f4)
        at += like[k].size
    return out


def _start(p: dict):
    """The parameters after learning the sample, as one row."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, first = [], []
        for batch in batches:
            w += batch.column(0).to_pylist()
            first += batch.column(1).to_pylist()
        if w:
            order = sorted(range(len(w)), key=lambda k: (zlib.crc32(w[k]), w[k], first[k]))
            own = np.frombuffer(b"".join([w[k] for k in order]), "<u2").reshape(len(w), -1)
            found = fit(p, own, np.array(first)[order], START_EPOCHS, RATE)
            yield pa.RecordBatch.from_arrays([pa.array([_flat(found).astype("<f4").tobytes()], pa.binary())], ["p"])

    return start


def _refine(shared):
    """A task's pass over its texts; gives its parameters, weighted by its number of targets."""

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        rng, total, held = np.random.default_rng(7), 0, []
        adam = Adam({k: v.copy() for k, v in shared.value.items()})

        def learn(last: bool) -> int:
            """Shuffles the windows held and takes whole steps; what is left over waits for more."""
            nonlocal held
            if not held:
                return 0
            w, first = (np.concatenate(x) for x in zip(*held, strict=True))
            order, seen = rng.permutation(len(w)), 0
            upto = len(w) if last else len(w) - len(w) % STEP_WINDOWS
            for at in range(0, upto, STEP_WINDOWS):
                part = order[at : min(at + STEP_WINDOWS, upto)]
                _, n, d = _gradients(adam.p, w[part].astype(np.int64), first[part])
                adam.update(d, STEP_WINDOWS * BLOCK, REFINE_RATE * len(part) / STEP_WINDOWS)
                seen += n
            held = [(w[order[upto:]], first[order[upto:]])]
            return seen

        waiting = 0
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for part in _runs(_id_counts(batch.column(1)), LAID_OUT):
                shift = _mixed_bits(rows[part], np.zeros(1, np.int64)) % np.uint64(STRIDE)
                w, first = windows(*_ids(batch.column(1), part), lambda text, block: (block + shift[text].astype(np.int64)) % STRIDE == 0)  # noqa: B023
                held.append((w.astype(np.uint16), first))
                waiting += len(w)
                if waiting >= SHUFFLED:
                    total, waiting = total + learn(False), 0
        total += learn(True)
        if total:
            flat = _flat(adam.p).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * total), pa.array(np.full(len(flat), total))], ["k", "v", "n"])

    return refine


@dataclass
class Model:
    p: dict[str, np.ndarray]
    n: int
    v: int


def train(numbered: DataFrame, counts: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters learned from the rows (row, trained, n_ids, ids) that are trained on."""
    sc = numbered.sparkSession.sparkContext
    own = numbered.where("trained").select("row", "ids")
    blocks = numbered.where("trained").agg(F.coalesce(F.sum(F.ceil(F.col("n_ids") / BLOCK)), F.lit(0))).first()[0]
    p = new_params(counts)
    if not blocks:
        return p
    sample = written(own.mapInArrow(_sample(START_WINDOWS / blocks), "w binary, first boolean"), "lm-sample")  # START_WINDOWS rows, give or take chance
    for r in sample.coalesce(1).mapInArrow(_start(p), "p binary").collect():
        p = _shaped(np.frombuffer(r.p, "<f4"), p)
    if own.rdd.getNumPartitions() > MODELS:
        own = own.coalesce(MODELS)
    mean = own.mapInArrow(_refine(sc.broadcast(p)), "k long, v double, n long").groupBy("k").agg((F.sum("v") / F.sum("n")).alias("v")).toArrow()
    if mean.num_rows:
        flat = np.empty(mean.num_rows)
        flat[mean.column("k").to_numpy()] = mean.column("v").to_numpy()
        p = _shaped(flat, p)
    return p


# Scoring


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        for batch in batches:
            sums = []
            for part in _runs(_id_counts(batch.column(1)), LAID_OUT):
                flat, size = _ids(batch.column(1), part)
                x, before, first, y, places = blocks_of(flat, size)
                lp = log_probs(shared.value, x, before, first, y)
                sums.append(np.add.reduceat(lp[places].astype(np.float64), np.cumsum(size) - size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*sums, np.zeros(0)])), *batch.columns[2:]], ["row", "attn", *batch.schema.names[2:]])

    return score


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    sc, path = docs.sparkSession.sparkContext, path or vocabulary_path()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    counts = written(texts.select("id", "text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    hot = {bytes(r.word): r.c for r in hot_words(counts).collect()}
    found = counts.mapInArrow(_count_subwords(path), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    by_id = np.zeros(ids_of(path).encoding.n_vocab, np.int64)
    by_id[found.column("t").to_numpy()] = found.column("n").to_numpy()
    vocabulary = Vocabulary.of(by_id)
    shared = sc.broadcast((path, vocabulary, hot))  # HOT_WORDS words and the vocabulary
    numbered = written(texts.mapInArrow(_number(shared), NUMBERED), "lm-numbered")
    model_counts = vocabulary.counts.copy()
    model_counts[END] = hot.get(b"", 0)
    p = sc.broadcast(train(numbered, model_counts))
    tail = numbered.select("row", F.explode("tail").alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.n").alias("n"))
    tail = tail.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    known = F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_tail")
    tail = tail.groupBy("row").agg(known, F.sum(F.col("n") * F.log10(F.col("c") + 0.1)).alias("base_tail"))
    own = numbered.select("row", "ids", "doc_id", "n_tokens", "left_open", "n_hot", "base_hot")
    own = own.mapInArrow(_score(p), "row long, attn double, doc_id long, n_tokens long, left_open double, n_hot long, base_hot double")
    both = own.join(tail, "row", "left")
    scale = float(np.log10(n + 0.1 * (v + 1)))
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("n_hot") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_hot") + F.coalesce("base_tail", F.lit(0.0)) - F.col("n_tokens") * scale).alias("base_score"),
        ((F.col("attn") + F.col("left_open")) / LN10).alias("score"),
    )


def hot_words(counts: DataFrame) -> DataFrame:
    """The most frequent words, HOT_WORDS at most: those above a count that few enough reach, found on the counts of counts."""
    per = counts.groupBy("c").agg(F.count(F.lit(1)).alias("k")).where("c > 1").toArrow()
    c, k = (per.column(x).to_numpy() for x in ("c", "k"))
    order = np.argsort(-c)
    fits = np.cumsum(k[order]) <= HOT_WORDS
    least = int(c[order][fits][-1]) if fits.any() else None
    return counts.where(F.lit(False) if least is None else F.col("c") >= least)
