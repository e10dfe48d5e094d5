"""Language-model scores: a log-bilinear model beside smoothed unigram counts of the whole corpus.

The model predicts a word from the two before it. The most frequent words have vectors of their own; all other words fall
into SPELLINGS classes by their last two bytes, with the smoothed count of the word inside its class. Outputs are factored
into classes, so that normalising costs a few hundred products a token: words sorted by their ends, CLASS of them a class.

Training is noise-contrastive estimation in numpy. The training texts are dealt into shards by a hash of the row, as
many as the corpus has tokens for; each shard is learnt from the same start in the order of that hash, the parameters are
averaged, and that goes on for some rounds. Nothing of this depends on how the input is split.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import fold, shared, text_bytes

#: How the end token is kept among the words; no word is empty.
END = b""
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
#: Most occurrences of a trigram that make one training row.
HEAVY = 16
#: Classes of the words outside the vocabulary, and words in a class of it.
SPELLINGS, CLASS = 64, 64
#: Tokens whose probabilities are worked out at once, and that are trained on before the next are read.
BLOCK, LESSON = 1 << 15, 1 << 19
LOG10 = float(np.log(10))
#: Parts of a model whose rows are averaged.
NEAR, FAR, CLASSES, WORDS = range(4)


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def spelling(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SPELLINGS


def _counts(batches):
    """(word, n): sums over a task, handed on whenever HELD distinct words are reached."""
    seen: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for text in b.column(0):
            seen.update(tokens(text.as_py()))
            seen[END] += 1
            if len(seen) > HELD:
                yield rows()
                seen.clear()
    if seen:
        yield rows()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts (text binary), the end token included."""
    return texts.select("text").mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class LogBilinear:
    """P(word | two before). Entities: the vocabulary, the spelling classes, the end, and as context the front."""

    place: dict[bytes, int]
    near: np.ndarray  # context vectors of the word before
    far: np.ndarray  # of the word before that
    classes: np.ndarray  # output vectors of the classes, the bias last
    words: np.ndarray  # output vectors of the vocabulary, the bias last

    @property
    def class_of(self) -> np.ndarray:
        """The class of each entity that can come out: one for CLASS words, one for each spelling, one for the end."""
        v = len(self.place)
        blocks = -(-v // CLASS)
        return np.concatenate((np.arange(v) // CLASS, blocks + np.arange(SPELLINGS + 1)))

    def log_probabilities(self, c2: np.ndarray, c1: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Natural logarithms for tokens e after c2 c1, normalised over classes and then over the words of a class."""
        out, owner, v = np.empty(len(e)), self.class_of[e], len(self.place)
        for at in range(0, len(e), BLOCK):
            part = slice(at, at + BLOCK)
            q, own = self.near[c1[part]] + self.far[c2[part]], owner[part]
            logit = q @ self.classes[:, :-1].T + self.classes[:, -1]
            got = _chosen(logit, own)
            word = np.flatnonzero(e[part] < v)
            order = word[np.argsort(own[word], kind="stable")]
            ends = np.flatnonzero(np.append(np.diff(own[order]) != 0, True)) + 1 if len(order) else []
            first = 0
            for end in ends:
                rows, block = order[first:end], slice(int(own[order[first]]) * CLASS, (int(own[order[first]]) + 1) * CLASS)
                inside = q[rows] @ self.words[block, :-1].T + self.words[block, -1]
                got[rows] += _chosen(inside, e[part][rows] - block.start)
                first = end
            out[part] = got
        return out


def _chosen(logit: np.ndarray, which: np.ndarray) -> np.ndarray:
    """log softmax at one column of each row."""
    top = logit.max(1)
    return (logit[np.arange(len(which)), which] - top - np.log(np.exp(logit - top[:, None]).sum(1))).astype(float)


def ids_of(words: list[bytes], place: dict[bytes, int]) -> np.ndarray:
    """Front, front, words, end."""
    n, get = len(place), place.get
    out = np.empty(len(words) + 3, np.int32)
    out[:2], out[-1] = n + SPELLINGS + 1, n + SPELLINGS
    out[2:-1] = np.fromiter((i if (i := get(w)) is not None else n + spelling(w) for w in words), np.int32, len(words))
    return out


def _ids(batches, place: dict[bytes, int]):
    """Rows (shard, row, ids) of (shard, row, text)."""
    for b in batches:
        ids = [ids_of(tokens(t.as_py()), place) for t in b.column(2)]
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), flat)], ["shard", "row", "ids"])


class _Pupil:
    """One shard's parameters, by Adagrad."""

    def __init__(self, model: LogBilinear, noise: np.ndarray, samples: int, inside: int, size: int, rate: float):
        self.owner, self.v = model.class_of, len(model.place)
        self.parts = [np.array(x, np.float32) for x in (model.near, model.far, model.classes, model.words)]
        self.grown = [np.full((len(x), 1), 1e-3, np.float32) for x in self.parts]
        self.samples, self.inside, self.size, self.rate = samples, inside, size, rate
        self.pick, self.log_noise = np.cumsum(noise), np.log(samples * noise).astype(np.float32)
        self.rng = np.random.default_rng(11)
        self.held, self.n_held, self.total = [], 0, 0

    def _move(self, part: int, rows: np.ndarray, grad: np.ndarray) -> None:
        """Equal rows of a batch are summed first."""
        order = np.argsort(rows, kind="stable")
        rows, grad = rows[order], grad[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        self._apply(part, rows[first], np.add.reduceat(grad, first, axis=0))

    def _apply(self, part: int, rows: np.ndarray, grad: np.ndarray) -> None:
        self.grown[part][rows] += (grad * grad).mean(axis=1, keepdims=True)
        self.parts[part][rows, : grad.shape[1]] -= self.rate * grad / np.sqrt(self.grown[part][rows])

    def _step(self, c2, c1, e, weight) -> None:
        """Tell a batch's classes from `samples` classes drawn by their counts, and its words from `inside` words of their class."""
        near, far, classes, words = self.parts
        q = near[c1] + far[c2]
        one = np.ones((len(q), 1), np.float32)
        y = self.owner[e]
        fake = np.minimum(np.searchsorted(self.pick, self.rng.random(self.samples) * self.pick[-1]), len(self.pick) - 1)
        true = (q * classes[y, :-1]).sum(1) + classes[y, -1] - self.log_noise[y]
        false = q @ classes[fake, :-1].T + classes[fake, -1] - self.log_noise[fake]
        d_true = -weight / (1 + np.exp(np.clip(true, -30, 30)))
        d_false = weight[:, None] / (1 + np.exp(-np.clip(false, -30, 30)))
        d_q = d_true[:, None] * classes[y, :-1] + d_false @ classes[fake, :-1]
        full = np.concatenate((q, one), 1)
        # few classes: one product with the indicator of each token's class instead of a sort
        is_in = np.zeros((len(classes), len(q)), np.float32)
        is_in[y, np.arange(len(q))] = d_true
        grad = is_in @ full
        np.add.at(grad, fake, d_false.T @ full)
        self._apply(CLASSES, np.arange(len(classes)), grad)
        w = np.flatnonzero(e < self.v)
        if len(w):
            low = y[w] * CLASS
            many = np.minimum(CLASS, self.v - low)
            other = low[:, None] + (self.rng.random((len(w), self.inside)) * many[:, None]).astype(np.int64)
            chance = np.log(self.inside / many).astype(np.float32)
            qw, own, oth = q[w], words[e[w]], words[other]
            true = (qw * own[:, :-1]).sum(1) + own[:, -1] - chance
            false = np.matmul(oth[:, :, :-1], qw[:, :, None])[:, :, 0] + oth[:, :, -1] - chance[:, None]
            d_true = -weight[w] / (1 + np.exp(np.clip(true, -30, 30)))
            d_false = weight[w, None] / (1 + np.exp(-np.clip(false, -30, 30)))
            d_q[w] += d_true[:, None] * own[:, :-1] + np.matmul(d_false[:, None, :], oth[:, :, :-1])[:, 0]
            fw = full[w]
            self._move(WORDS, np.concatenate((e[w], other.ravel())), np.concatenate((d_true[:, None] * fw, (d_false[:, :, None] * fw[:, None, :]).reshape(-1, fw.shape[1]))))
        self._move(NEAR, c1, d_q), self._move(FAR, c2, d_q)

    def read(self, ids: np.ndarray) -> None:
        self.held.append(ids), self._count(len(ids))
        if self.n_held >= LESSON:
            self.learn()

    def _count(self, n: int) -> None:
        self.n_held += n
        self.total += n - 2

    def learn(self) -> None:
        """Equal trigrams go together by up to HEAVY, weighted."""
        if not self.held:
            return
        m = self.v + SPELLINGS + 2
        flat = np.concatenate([(x[:-2].astype(np.int64) * m + x[1:-1]) * m + x[2:] for x in self.held])
        keys, count = np.unique(flat, return_counts=True)
        times = -(-count // HEAVY)
        keys, count = np.repeat(keys, times), np.repeat((count / times).astype(np.float32), times)
        order = self.rng.permutation(len(keys))
        for at in range(0, len(order), self.size):
            k, n = keys[order[at : at + self.size]], count[order[at : at + self.size]]
            self._step(k // m**2, k // m % m, k % m, n / n.sum())
        self.held, self.n_held = [], 0

    def rows(self):
        for part, x in enumerate(self.parts):
            wide = np.zeros((len(x), self.parts[WORDS].shape[1]), np.float32)
            wide[:, : x.shape[1]] = x
            lead = [np.full(len(x), part, np.int32), np.arange(len(x), dtype=np.int32), np.full(len(x), self.total, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*lead, *wide.T)], ["part", "row", "weight", *(f"x{i}" for i in range(wide.shape[1]))])


def _train(batches, model: LogBilinear, noise: np.ndarray, **how):
    """Rows (part, row, weight, x0, x1, ..) of the parameters of each shard among rows (shard, row, ids) in their order."""
    pupil, shard = None, None
    for b in batches:
        lists = b.column(2)
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        for r, own in enumerate(b.column(0).to_pylist()):
            if own != shard:
                if pupil:
                    pupil.learn()
                    yield from pupil.rows()
                pupil, shard = _Pupil(model, noise, **how), own
            pupil.read(flat[ends[r] : ends[r + 1]])
    if pupil:
        pupil.learn()
        yield from pupil.rows()


def fit(texts: DataFrame, top: list[tuple[bytes, int]], rare: np.ndarray, n_ends: int, n_tokens: int, width: int = 16, samples: int = 32, inside: int = 3, size: int = 2048, rounds: int = 2, rate: float = 0.5, shard: int = 1 << 20) -> LogBilinear:
    """A model of the words `top` (word, count) from all texts (row, text): n_tokens // `shard` + 1 shards, `rounds` rounds.

    rare: the smoothed counts of the spelling classes. Only the averaged parameters come to the driver.
    """
    top = sorted(top, key=lambda x: x[0][::-1])
    place = {w: i for i, (w, _) in enumerate(top)}
    v, rng = len(place), np.random.default_rng(3)
    count = np.array([*(c for _, c in top), *rare, n_ends], float) + 0.5
    model = LogBilinear(place, *(rng.normal(0, 0.05, (v + SPELLINGS + 2, width)).astype(np.float32) for _ in range(2)), np.zeros(0), np.zeros(0))
    owner = model.class_of
    noise = np.bincount(owner, count)
    noise /= noise.sum()
    inner = np.log(count[:v] / np.bincount(owner[:v], count[:v])[owner[:v]]) if v else np.zeros(0)
    model.classes, model.words = (np.concatenate((rng.normal(0, 0.05, (len(b), width)), np.reshape(b, (-1, 1))), 1).astype(np.float32) for b in (np.log(noise), inner))
    sc = texts.sparkSession.sparkContext
    shards = n_tokens // shard + 1
    sent = sc.broadcast(place)
    dealt = texts.select(F.pmod("row", F.lit(shards)).alias("shard"), "row", "text").mapInArrow(lambda it: _ids(it, sent.value), "shard long, row long, ids array<int>")
    dealt = shared(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "row"))
    schema = "part int, row int, weight long, " + ", ".join(f"x{i} float" for i in range(width + 1))
    how = {"samples": samples, "inside": inside, "size": size, "rate": rate}
    for _ in range(rounds):
        start = sc.broadcast(model)
        learnt = dealt.mapInArrow(lambda it, start=start: _train(it, start.value, noise, **how), schema)
        # sums of whole numbers, so that their order does not count
        exact = [F.sum(F.round(F.col(f"x{i}").cast("double") * (1 << 24)).cast("decimal(20,0)") * F.col("weight")).alias(f"x{i}") for i in range(width + 1)]
        mean = learnt.groupBy("part", "row").agg(F.sum("weight").alias("weight"), *exact)
        got = mean.select("part", "row", *[(F.col(f"x{i}").cast("double") / F.col("weight") / (1 << 24)).alias(f"x{i}") for i in range(width + 1)]).toArrow()
        if got.num_rows == 0:
            break
        part, row = got["part"].to_numpy(), got["row"].to_numpy()
        x = np.stack([got[f"x{i}"].to_numpy() for i in range(width + 1)], 1).astype(np.float32)
        fresh = [np.array(a) for a in (model.near, model.far, model.classes, model.words)]
        for p, a in enumerate(fresh):
            a[row[part == p]] = x[part == p][:, : a.shape[1]]
        model = LogBilinear(place, *fresh)
        start.unpersist()
    return model


def _score(batches, model: dict):
    """Rows (doc, word, n, tokens, known, base, lm): one for each text, with what its frequent words give and the
    word in a place of its own, and one for each of its rare words."""
    lbl, frequent, inside, end_cost = (model[k] for k in ("model", "frequent", "inside", "end"))
    place = lbl.place
    v = len(place)
    for b in batches:
        names, texts = b.column(0).to_pylist(), b.column(1)
        at = 0
        while at < b.num_rows:
            cols: list[list] = [[] for _ in range(7)]
            ids, firsts = [], []
            while at < b.num_rows and sum(map(len, ids[-64:])) < BLOCK and len(ids) < 64:
                words = tokens(texts[at].as_py())
                ids.append(ids_of(words, place))
                base, known = end_cost
                lm = 0.0
                doc, own, out = names[at], Counter(words), [[b" " + names[at]], [0]]
                for word, n in own.items():
                    hit = frequent.get(word)
                    if hit is None:
                        out[0].append(word)
                        out[1].append(n)
                    else:
                        base += n * hit
                        known += n
                        if word not in place:
                            lm += n * hit
                more = len(out[0]) - 1
                firsts.append(len(cols[0]))
                for col, x in zip(cols, ([doc] * (more + 1), *out, *([x] + [0] * more for x in (len(words) + 1, known, base, lm))), strict=True):
                    col.extend(x)
                at += 1
            e = np.concatenate([x[2:] for x in ids])
            got = lbl.log_probabilities(np.concatenate([x[:-2] for x in ids]), np.concatenate([x[1:-1] for x in ids]), e) / LOG10
            # of the words outside the vocabulary the counts within all words come from above or from the join
            got += np.concatenate((np.zeros(v), inside, [0.0]))[e]
            starts = np.cumsum([0, *(len(x) - 2 for x in ids[:-1])])
            for first, x in zip(firsts, np.add.reduceat(got, starts).tolist(), strict=True):
                cols[6][first] += x
            yield _batch(cols)


def _batch(cols):
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc", "word", "n", "tokens", "known", "base", "lm"])


def score_texts(docs: DataFrame, parts: int = 10, vocabulary: int = 4096, frequent: int = 100_000, add: float = 0.1, **training) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text).

    Training texts are those whose crc32 of the id modulo `parts` is not 0. base_score is the log10 probability under their
    smoothed unigram counts; score that of the log-bilinear model, in which the `vocabulary` most frequent words have vectors, and
    the others the class of their spelling, times the smoothed count of the word within it; each such class has room for
    one unseen word. Counts are of the whole corpus. At most `frequent` words, the most frequent ones, travel to all tasks;
    the counts of all other words meet the documents' words in a join. Ties at the border go by bytes, for the vocabulary, and stay
    outside, for the frequent words. Null texts are empty, a null id is in the fold of the empty text, rows repeated repeat.
    Without a training text every word is unseen.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", parts) == 0).alias("held_out"), text_bytes().alias("text"))
    counts = shared(word_counts(rows.where("not held_out")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = (counts.where(F.octet_length("word") == 0).select("c").first() or [0])[0]
    words = counts.where(F.octet_length("word") > 0)
    # the least count of the frequent words, from the sizes of some hundred steps of counts
    step = F.floor(F.log2("c") * 16)
    left, least = frequent, float("inf")
    for r in words.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("s")).collect():
        left -= r["n"]
        if left < 0:
            break
        least = r["c"]
    got = words.where(F.col("c") >= F.lit(least)).toArrow()
    often = sorted(zip(got["word"].to_pylist(), got["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    top = often[:vocabulary]
    sums = words.groupBy((F.crc32(F.substring("word", -2, 2)) % SPELLINGS).alias("s")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    rare = np.full(SPELLINGS, add)
    for r in sums:
        rare[r["s"]] += r["c"] + add * r["n"]
    for w, c in top:
        rare[spelling(w)] -= c + add
    rare = np.maximum(rare, add)
    keyed = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    model = fit(keyed.where("not held_out").select("row", "text"), top, rare, ends, n, **training)
    whole = n + add * (v + 1)
    cost = lambda c: float(np.log10((c + add) / whole))
    table = {"model": model, "frequent": {w: cost(c) for w, c in often}, "inside": np.log10(whole / rare), "end": (cost(ends), int(ends > 0))}
    sent = docs.sparkSession.sparkContext.broadcast(table)
    # equal rows share a key; their scores are equal and go back to each of them
    keyed = rows.withColumn("doc", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.hex(F.xxhash64("text"))).cast("binary"))
    pieces = keyed.select("doc", "text").mapInArrow(lambda it: _score(it, sent.value), "doc binary, word binary, n long, tokens long, known long, base double, lm double")
    unseen = F.col("c").isNull()
    rare = F.when(F.col("n") > 0, F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + add) / F.lit(float(whole)))).otherwise(0.0)
    joined = pieces.join(words, "word", "left")
    sums = joined.groupBy("doc").agg(
        F.sum("tokens").alias("n_tokens"), F.sum(F.col("known") + F.when(unseen, 0).otherwise(F.col("n"))).alias("n_known"),
        F.sum(F.col("base") + rare).alias("base_score"), F.sum(F.col("lm") + rare).alias("score"), F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("copies"),
    )
    per = {c: (F.col(c) / F.col("copies")) for c in ("base_score", "score")} | {c: (F.col(c) / F.col("copies")).cast("long") for c in ("n_tokens", "n_known")}
    sums = sums.withColumns(per)
    out = keyed.select("doc_id", "held_out", "doc").join(sums, "doc")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
