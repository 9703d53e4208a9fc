"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text; a document's probabilities are the mean over its bytes. Both directions run
through the whole text with their state carried along; texts of like length advance together. Of a long text the backward
states are kept at every PIECE bytes and worked out again within a piece, so that memory does not grow with the labels.
Weights are trained in numpy by backpropagation through time on windows from a bounded sample of labelled documents,
TRAIN_DOCS per language as an expected number; WINDOWS places anywhere in a document's whole text are cut out on the
executors, so the driver sees bytes of the order of TRAIN_DOCS x WINDOWS x (TRAIN_WINDOW + 2 WARM_UP) per language, however long the
texts are. The states at a window's ends come from running over the bytes beyond them.

Defined cases: a null text, or one without a letter, is `und` with score 0; a null lang is never learned from; without
any training document everything is `und`; repeated rows and equal doc_ids keep a row each; a null doc_id hashes as the
empty string; columns other than doc_id, text and (for training) lang are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table

HIDDEN = 8
TRAIN_DOCS = 600
STEPS = 240
BATCH = 192
TRAIN_WINDOW = 48
WINDOWS = 24  # places cut from a document of the sample
WARM_UP = 48  # bytes beyond each end of a training window that the states are run over
STEP = 128  # bytes of each text worked on between two products with the label weights
SLAB = 8 << 20  # places of texts that advance together
PIECE = 1 << 16  # bytes of a long text whose backward states are held at a time
HELD = 48 << 20  # bytes of texts sorted by length at a time
SEED = 7


def _fold(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % 5


def sample(training: DataFrame, per_language: int = TRAIN_DOCS, windows: int = WINDOWS) -> list[tuple[str, list[tuple[bytes, bytes, bytes]]]]:
    """(lang, windows) of about per_language documents of each language, drawn by hash. A window is what stands before it,
    its own bytes, and what comes after, cut from a place drawn by hash anywhere in the text."""
    usable = training.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    # a row per language
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    unit = float(1 << 40)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1 << 40)) / unit
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in sorted(counts.items())])
    drawn = usable.where(draw < share).select("lang", F.col("text").cast("binary").alias("b"), F.xxhash64("doc_id", "text").alias("h"))
    last = F.greatest(F.octet_length("b") - TRAIN_WINDOW, F.lit(0))

    def cut(i):
        at = F.pmod(F.xxhash64("h", i), last + 1).cast("int")
        lead = F.least(at, F.lit(WARM_UP))
        part = lambda start, n: F.substring("b", start + 1, n)
        return F.struct(part(at - lead, lead).alias("lead"), part(at, F.lit(TRAIN_WINDOW)).alias("part"), part(at + TRAIN_WINDOW, F.lit(WARM_UP)).alias("rest"))

    rows = drawn.select("lang", "h", F.transform(F.sequence(F.lit(1), F.lit(windows)), cut).alias("w")).collect()
    found = [(r["lang"], [tuple(map(bytes, w)) for w in r["w"]], r["h"]) for r in rows]
    return [(lang, cuts) for lang, cuts, _ in sorted(found, key=lambda r: (r[2], r[0], r[1]))]


class Network:
    """Weights: per direction a table of byte inputs (256, 3H) and U (H, 3H); then V (2H, L) and c (L)."""

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = SEED):
        import numpy as np

        rng = np.random.default_rng(seed)
        h = hidden
        self.h = h
        self.w = [
            *(rng.normal(0, s, size).astype(np.float32) for _ in range(2) for s, size in ((0.3, (256, 3 * h)), (0.3, (h, 3 * h)))),
            rng.normal(0, 0.3, (2 * h, n_labels)).astype(np.float32),
            np.zeros(n_labels, np.float32),
        ]

    @classmethod
    def of(cls, weights: list) -> Network:
        net = cls.__new__(cls)
        net.w, net.h = weights, weights[1].shape[0]
        return net

    def _run(self, x, mask, table_, u, keep=None, state=None):
        """States (T, B, H) over x (T, B) in the order given, from `state` or zeros; keep gathers what backpropagation
        needs. A mask (T, B) of zeros and ones holds a state at zero."""
        import numpy as np

        h = self.h
        state = np.zeros((x.shape[1], h), np.float32) if state is None else state
        states = np.empty((*x.shape, h), np.float32)
        # a sigmoid is a hyperbolic tangent of half the sum; halves are exact, so they are taken once, of the weights
        table_, u = table_.copy(), u.copy()
        table_[:, : 2 * h] *= np.float32(0.5)
        u[:, : 2 * h] *= np.float32(0.5)
        for t in range(len(x)):
            inp, rec = table_.take(x[t], 0), state @ u
            gates = inp[:, : 2 * h] + rec[:, : 2 * h]
            np.tanh(gates, out=gates)
            gates *= np.float32(0.5)
            gates += np.float32(0.5)  # update, reset
            z, r = gates[:, :h], gates[:, h:]
            new = r * rec[:, 2 * h :]
            new += inp[:, 2 * h :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((state, z, r, new, rec[:, 2 * h :]))
            now = np.subtract(state, new, out=states[t])
            now *= z
            now += new
            if mask is not None:
                now *= mask[t][:, None]
            state = now
        return states

    def probabilities(self, texts: list[bytes]):
        """Mean label probabilities (texts, L) over all bytes of each text; none of them empty."""
        import numpy as np

        out = np.empty((len(texts), len(self.w[5])))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        most = max(1, min(SLAB, (128 << 20) // (4 * len(self.w[5]))))
        at = 0
        while at < len(order):
            longest = int(lengths[order[at]])
            if longest > most:
                out[order[at]] = self._long(texts[order[at]])
                at += 1
                continue
            lanes = max(1, most // longest)  # texts that have ended cost room, not time
            mine = order[at : at + lanes]
            out[mine] = self._slab([texts[i] for i in mine], lengths[mine])
            at += lanes
        return out

    def _slab(self, texts: list[bytes], lengths):
        """`probabilities` of texts of falling length."""
        import numpy as np

        h, (tf, uf, tb, ub, v, c) = self.h, self.w
        t, n = int(lengths[0]), len(texts)
        x, y = np.zeros((t, n), np.uint8), np.zeros((t, n), np.uint8)  # the texts, and from their ends
        for i, text in enumerate(texts):
            bytes_ = np.frombuffer(text, np.uint8)
            x[: len(bytes_), i], y[: len(bytes_), i] = bytes_, bytes_[::-1]
        late = np.empty((t, n, len(c)), np.float32)  # what the backward states say, from each text's end
        state, sums = np.zeros((n, h), np.float32), np.zeros((n, len(c)))
        for at in range(0, t, STEP):
            k = int(np.searchsorted(-lengths, -at, "left"))  # texts that are still going on
            states = self._run(y[at : at + STEP, :k], None, tb, ub, state=state[:k])
            late[at : at + STEP, :k] = (states.reshape(-1, h) @ v[h:] + c).reshape(len(states), k, -1)
            state = states[-1]
        state = np.zeros((n, h), np.float32)
        for at in range(0, t, STEP):
            k = int(np.searchsorted(-lengths, -at, "left"))
            states = self._run(x[at : at + STEP, :k], None, tf, uf, state=state[:k])
            state = states[-1]
            from_end = lengths[None, :k] - 1 - np.arange(at, at + len(states))[:, None]
            inside = from_end >= 0
            p = (states.reshape(-1, h) @ v[:h]).reshape(len(states), k, -1)
            p += late[np.maximum(from_end, 0), np.arange(k)[None, :]]
            p -= p.max(2, keepdims=True)
            np.exp(p, out=p)
            p *= (inside / p.sum(2))[:, :, None]
            sums[:k] += p.sum(0)
        return sums / lengths[:, None]

    def _long(self, text: bytes):
        """`probabilities` of one text, piece by piece. The first pass, from the text's end, keeps the state at the end of each
        piece; the second works a piece's backward states out again from there, beside its forward states."""
        import numpy as np

        h, (tf, uf, tb, ub, v, c) = self.h, self.w
        x = np.frombuffer(text, np.uint8)[:, None]
        starts = range(0, len(x), PIECE)
        state, after = np.zeros((1, h), np.float32), {}
        for at in reversed(starts):
            after[at] = state
            for low in range(min(at + PIECE, len(x)), at, -STEP):
                state = self._run(x[max(at, low - STEP) : low][::-1], None, tb, ub, state=state)[-1]
        state, sums = np.zeros((1, h), np.float32), np.zeros(len(c))
        for at in starts:
            piece = x[at : at + PIECE]
            back = self._run(piece[::-1], None, tb, ub, state=after.pop(at))[::-1]
            states = self._run(piece, None, tf, uf, state=state)
            state = states[-1]
            p = states[:, 0] @ v[:h] + (back[:, 0] @ v[h:] + c)
            p -= p.max(1, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(1, keepdims=True)
            sums += p.sum(0)
        return sums / len(x)

    def ends(self, before, after):
        """States of both directions at the ends of windows, after running over the bytes beyond them: (bytes, inside) of
        shape (T, B) each, in text order, with zeros in `inside` where there is no byte."""
        tf, uf, tb, ub = self.w[:4]
        return self._run(*before, tf, uf)[-1], self._run(after[0][::-1], after[1][::-1], tb, ub)[-1]

    def gradients(self, x, labels, ends=(None, None)):
        """(loss, gradients) of the mean cross-entropy over all bytes of x (T, B); labels (B); ends: where states start."""
        import numpy as np

        h, (tf, uf, tb, ub, v, c) = self.h, self.w
        n, size = x.size, x.shape
        kept_f: list = []
        kept_b: list = []
        fwd = self._run(x, None, tf, uf, kept_f, ends[0])
        bwd = self._run(x[::-1], None, tb, ub, kept_b, ends[1])
        both = np.concatenate((fwd, bwd[::-1]), 2).reshape(n, 2 * h)
        out = both @ v + c
        out -= out.max(1, keepdims=True)
        p = np.exp(out)
        p /= p.sum(1, keepdims=True)
        at = (np.arange(n), np.tile(labels, size[0]))
        loss = float(-np.log(p[at] + 1e-12).mean())
        p[at] -= 1
        p /= n
        d_both = (p @ v.T).reshape(*size, 2 * h)
        grads = [None] * 4 + [both.T @ p, p.sum(0)]
        for k, (seq, kept, u, d) in enumerate(((x, kept_f, uf, d_both[:, :, :h]), (x[::-1], kept_b, ub, d_both[::-1, :, h:]))):
            d_in, d_u, d_state = np.empty((*size, 3 * h), np.float32), np.zeros_like(u), np.zeros((size[1], h), np.float32)
            for t in range(size[0] - 1, -1, -1):
                before, z, r, new, rec = kept[t]
                d_state = d_state + d[t]
                d_new = d_state * (1 - z) * (1 - new * new)
                d_in[t, :, :h] = d_state * (before - new) * z * (1 - z)
                d_in[t, :, h : 2 * h] = d_new * rec * r * (1 - r)
                d_in[t, :, 2 * h :] = d_new
                d_rec = d_in[t].copy()
                d_rec[:, 2 * h :] *= r
                d_u += before.T @ d_rec
                d_state = d_state * z + d_rec @ u.T
            d_table = np.zeros((256, 3 * h), np.float32)
            np.add.at(d_table, seq.ravel(), d_in.reshape(n, 3 * h))
            grads[2 * k], grads[2 * k + 1] = d_table, d_u
        return loss, grads


def train(samples: list[tuple[str, list]], steps: int = STEPS, seed: int = SEED):
    """(languages, network) fitted to the samples by Adam; (languages, None) for fewer than two languages."""
    import numpy as np

    languages = sorted({k for k, _ in samples})
    if len(languages) < 2:
        return languages, None
    rng = np.random.default_rng(seed)
    by = [[cuts for k, cuts in samples if k == lang] for lang in languages]
    net = Network(len(languages), seed=seed)
    m, s = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w]
    for step in range(1, steps + 1):
        labels = rng.integers(0, len(languages), BATCH)
        x = np.full((BATCH, TRAIN_WINDOW), 32, np.uint8)
        before, after = ([np.zeros((BATCH, WARM_UP), np.uint8), np.zeros((BATCH, WARM_UP), np.float32)] for _ in range(2))
        for row, label in enumerate(labels):
            cuts = by[label][rng.integers(len(by[label]))]
            lead, part, rest = (np.frombuffer(piece, np.uint8) for piece in cuts[rng.integers(len(cuts))])
            x[row, : len(part)] = part
            if len(lead):
                before[0][row, -len(lead) :], before[1][row, -len(lead) :] = lead, 1
            after[0][row, : len(rest)], after[1][row, : len(rest)] = rest, 1
        turned = lambda pair: [np.ascontiguousarray(a.T) for a in pair]
        _, grads = net.gradients(np.ascontiguousarray(x.T), labels, net.ends(turned(before), turned(after)))
        rate = 0.02 * (1 - step / (steps + 1)) + 0.001
        for i, g in enumerate(grads):
            g = np.clip(g, -1, 1)
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.99 * s[i] + 0.01 * g * g
            net.w[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return languages, net


def predict(docs: DataFrame, languages: list[str], net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs."""
    # plain arrays, so that workers need no copy of this package; their size depends on the network alone
    shared = docs.sparkSession.sparkContext.broadcast((languages, net.w if net else None))

    def label(batches):
        import os

        os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
        import numpy as np
        import pyarrow as pa

        languages, weights = shared.value
        net = Network.of(weights) if weights else None

        def rows(ids, held, texts):
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            some = [i for i, text in enumerate(texts) if text is not None and languages]
            if some:
                p = net.probabilities([texts[i] for i in some]) if net else np.ones((len(some), 1))
                for i, k, q in zip(some, p.argmax(1).tolist(), p.max(1).tolist()):
                    langs[i], scores[i] = languages[k], min(1.0, q)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held), pa.array(langs), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

        parts, size = ([], [], []), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                columns = [c.slice(at, 256).to_pylist() for c in batch.columns]
                for column, part in zip(columns, parts):
                    part.extend(column)
                size += sum(len(t) for t in columns[2] if t is not None)
                if size > HELD:
                    yield rows(*parts)
                    parts, size = ([], [], []), 0
        if parts[0]:
            yield rows(*parts)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (_fold() == 0).alias("held_out"),
        F.when(F.col("text").rlike("\\p{L}"), F.col("text").cast("binary")).alias("text"),
    ).mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, *train(sample(docs.where(_fold() != 0))))
