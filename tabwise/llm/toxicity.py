"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

Kernel: words (with a mark where they begin) are compared by their subsequences of four letters within seven
characters, each occurrence weighing ``DECAY`` per character it spans, divided by a norm that depends on the number
of letters. Inserted characters and gaps therefore cost weight instead of losing the match; case, accents of one
vowel and common digit stand-ins are folded, and letters written one by one are read as one word.

Training: labels belong to documents. The words of labelled training documents are counted by label (whole texts of
at most ``SAMPLE_DOCS`` documents, those of smallest id hash; copies teach once). Word parts that are significantly
more frequent in toxic documents give the positive landmarks, frequent words of clean ones the negative. Words are
mapped to kernel values against the landmarks times the inverse square root of the landmarks' own kernel matrix; a
linear SVM in which each word weighs by its documents of either label separates them, and the clean words it ranks
highest are added and learned in further rounds. A logistic curve over six figures of a text (strongest word, and
sum, share and number of strong words) turns margins into a score between 0 and 1.

Scoring needs no kernel matrix: the SVM's function is one table of weights over four-letter subsequences, so each
distinct word of a batch is looked up once and whole texts are scored in one pass without a shuffle.

Defined results: null, empty and letterless texts have the score of a text without words; labels that are null do
not count; a document with several labels is toxic if one says so; with no toxic or no clean training document, or no
telling word part, every score is the training share of toxic documents (0 if there are none); an empty table gives
no rows.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import add_columns
from tabwise.session import cut_lineage

SAMPLE_DOCS = 8_000
LETTERS = 4
REACH = 7
DECAY = 0.75
LANDMARKS = 96
CLEAN_LANDMARKS = 48
TRAIN_WORDS = 12_000
LEAST_ODDS = 4
MINING_ROUNDS = 3
CACHE_WORDS = 300_000
BEGIN = "^"
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
PLACES = [(a, b, c) for c in range(3, REACH) for b in range(2, c) for a in range(1, b)]


def letter_table() -> np.ndarray:
    """Code point -> 1..26 for plain letters, 27..30 for others by their vowel (other scripts: by number), 31 for the
    mark of a word's beginning, 0 for the rest."""
    table = np.zeros(0x10000, np.uint8)
    for cp in range(0x10000):
        ch = chr(cp)
        if 0xD800 <= cp < 0xE000:
            continue
        plain = STAND_INS.get(ch, ch.lower())
        if len(plain) == 1 and "a" <= plain <= "z":
            table[cp] = ord(plain) - 96
        elif ch.isalpha():
            vowel = "aei".find(unicodedata.normalize("NFKD", ch)[:1].lower())
            table[cp] = 27 + vowel if vowel >= 0 else 30 if cp < 0x250 else 27 + cp % 4
    table[ord(BEGIN)] = 31
    return table


def joined_words(text: str) -> list[str]:
    """Lower-cased words, each behind its mark; three or more single letters in a row are one word too."""
    words = text.lower().split()
    single = [i for i, w in enumerate(words) if len(w) == 1]
    at = 0
    while at < len(single):
        end = at
        while end + 1 < len(single) and single[end + 1] == single[end] + 1:
            end += 1
        if end - at >= 2:
            words.append("".join(words[single[at] : single[end] + 1]))
        at = end + 1
    return [BEGIN + w for w in words]


class Kernel:
    """Subsequence features of many strings at once."""

    def __init__(self, letters: np.ndarray):
        self.letters = letters

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letter codes of all words, each followed by a gap no subsequence can cross, and the words' starts."""
        gap = " " * (REACH - 1)
        points = np.frombuffer((gap.join(words) + gap).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + len(gap)
        return self.letters[np.minimum(points, 0xFFFF)].astype(np.int32), np.concatenate([[0], np.cumsum(sizes)[:-1]])

    def norms(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Square root of the weights of a plain run of as many letters."""
        n = np.add.reduceat((codes > 0).astype(np.int64), starts)
        table = np.array([sum(DECAY ** (2 * (c + 1)) * max(0, k - c) for _, _, c in PLACES) for k in range(64)]) + 1e-6
        slope = sum(DECAY ** (2 * (c + 1)) for _, _, c in PLACES)
        return np.sqrt(np.where(n < 64, table[np.minimum(n, 63)], table[63] + slope * (n - 63)))

    def weighted(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """For each word the weights of its subsequences, summed and divided by its norm."""
        codes, starts = self.codes(words)
        n = len(codes) - REACH + 1
        total = np.zeros(len(codes), np.float32)
        first = codes[:n] << 15
        for a, b, c in PLACES:
            total[:n] += np.float32(DECAY ** (c + 1)) * weights[first | codes[a : a + n] << 10 | codes[b : b + n] << 5 | codes[c : c + n]]
        return np.add.reduceat(total, starts) / self.norms(codes, starts)

    def features(self, word: str) -> dict[int, float]:
        """Subsequence -> weight, divided by the norm."""
        codes, starts = self.codes([word])
        out: dict[int, float] = {}
        for i in range(len(codes) - REACH + 1):
            for a, b, c in PLACES:
                four = [int(codes[j]) for j in (i, i + a, i + b, i + c)]
                if all(four):
                    key = four[0] << 15 | four[1] << 10 | four[2] << 5 | four[3]
                    out[key] = out.get(key, 0.0) + DECAY ** (c + 1)
        norm = float(self.norms(codes, starts)[0])
        return {k: v / norm for k, v in out.items()}


@dataclass
class Model:
    weights: np.ndarray | None  # per four-letter subsequence
    bias: float
    slopes: list[float]  # of a text's figures
    shift: float
    share: float


def text_figures(margins: np.ndarray) -> list[float]:
    """What the score of a text is made of: its words' margins, summed up."""
    n, near = len(margins), 1 / (1 + np.exp(-6 * margins))
    over = int((margins > 0).sum())
    return [float(margins.max()), float(np.log1p(near.sum())), float(10 * near.mean()), float(np.log1p(over)), 10 * over / n, float(np.log1p(n))]


def word_scorer(weights: np.ndarray, bias: float):
    """A function from a text to its figures."""
    kernel, known = Kernel(letter_table()), {}

    def words_of(text):
        return joined_words((text or b"").decode("utf-8", "replace"))

    def prepare(texts):
        if len(known) > CACHE_WORDS:
            known.clear()
        new = list(set().union(*map(words_of, texts)).difference(known))
        if new:
            known.update(zip(new, (kernel.weighted(new, weights) + bias).tolist()))

    def figures(text: bytes | None) -> list[float]:
        words = words_of(text)
        if not words:
            return [-1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
        return text_figures(np.fromiter(map(known.__getitem__, words), float, len(words)))

    figures.prepare = prepare
    return figures


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by five."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", most: int = SAMPLE_DOCS) -> DataFrame:
    """(id, label) of at most ``most`` labelled documents that are not held out, those of smallest id hash."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    return known.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("__label")).orderBy(F.xxhash64(id_col), id_col).limit(most)


def _word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, toxic, clean): documents of each label that hold a word."""

    def run(batches):
        import pyarrow as pa

        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column("b").to_pylist(), batch.column("__label").to_pylist()):
                for w in set(joined_words((text or b"").decode("utf-8", "replace"))):
                    counts.setdefault(w, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())],
            names=["word", "toxic", "clean"],
        )

    parts = docs.select(F.col(text_col).cast("binary").alias("b"), "__label").mapInArrow(run, "word string, toxic bigint, clean bigint")
    return parts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _evidence(toxic, clean, share: float):
    """Log-likelihood of the observed share of toxic documents against the overall share, 0 where it lies below."""
    n = toxic + clean
    up = toxic * F.log(toxic / (n * share))
    down = F.when(clean > 0, clean * F.log(clean / (n * (1 - share)))).otherwise(0.0)
    return F.when(toxic > n * share, up + down).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model of the labelled documents that are not held out."""
    sample = cut_lineage(training_labels(labels.select(id_col, label_col), id_col, label_col, sample_docs))
    train = cut_lineage(docs.select(id_col, text_col).join(F.broadcast(sample), id_col).groupBy(text_col).agg(F.max("__label").alias("__label")))  # at most sample_docs labels; copies teach once
    sizes = {r["__label"]: r["n"] for r in train.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    share = n_toxic / max(1, n_toxic + n_clean)
    if not n_toxic or not n_clean:
        return Model(None, 0.0, [], 0.0, share)

    counts = cut_lineage(_word_counts(train, text_col))
    plain = F.concat(F.lit(BEGIN), F.regexp_replace("word", r"[^\p{L}]", ""))
    part = F.explode(F.expr("flatten(transform(sequence(4, 8), k -> if(length(w) >= k, transform(sequence(1, length(w) - k + 1), i -> substr(w, i, k)), array())))"))
    parts = counts.select(plain.alias("w"), "toxic", "clean").filter("length(w) between 5 and 24").select(part.alias("part"), "toxic", "clean")
    parts = cut_lineage(parts.groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    # a part counts if chance would not bring it about among as many parts, and if it is far rarer in clean documents
    evidence, odds = _evidence(F.col("toxic"), F.col("clean"), share), F.col("toxic") / n_toxic * n_clean / (F.col("clean") + 0.5)
    telling = parts.withColumn("e", evidence).filter((F.col("e") > float(np.log(10.0 * max(1, parts.count())))) & (odds > LEAST_ODDS))
    positive: list[str] = []
    for r in telling.orderBy(F.desc("e"), F.desc(F.length("part")), "part").limit(40 * LANDMARKS).collect():
        if len(positive) < LANDMARKS and not any(r["part"] in p or p in r["part"] for p in positive):  # one of parts inside each other
            positive.append(r["part"])
    if not positive:
        return Model(None, 0.0, [], 0.0, share)
    clean_words = counts.filter(F.col("clean") > 0)
    common = [r["word"] for r in clean_words.filter(F.length("word") > 4).orderBy(F.desc("clean"), "word").limit(CLEAN_LANDMARKS).collect()]

    kernel = Kernel(letter_table())
    landmarks = positive + common
    phi = [kernel.features(x) for x in landmarks]
    own = np.array([[sum(v * b.get(k, 0.0) for k, v in a.items()) for b in phi] for a in phi])
    scale, axes = np.linalg.eigh(own + 1e-3 * np.eye(len(own)))
    root = axes @ np.diag(1 / np.sqrt(np.maximum(scale, 1e-3))) @ axes.T

    def table(parts) -> np.ndarray:
        out = np.zeros(1 << 20, np.float32)
        for factor, f in parts:
            out[list(f)] += np.float32(factor) * np.fromiter(f.values(), np.float32, len(f))
        return out

    def taken(rows) -> dict[str, tuple[int, int]]:
        return {r["word"]: (r["toxic"], r["clean"]) for r in rows.collect()}

    telltale = plain.rlike("|".join(map(re.escape, positive)))
    similar = plain.rlike("|".join(sorted({re.escape(p[:3]) for p in positive})))
    words = taken(counts.filter(telltale).orderBy(F.desc("toxic"), "word").limit(TRAIN_WORDS // 3))
    words |= taken(counts.filter(similar).orderBy(F.xxhash64("word")).limit(TRAIN_WORDS // 2))
    words |= taken(counts.orderBy(F.xxhash64("word")).limit(TRAIN_WORDS // 3))
    for left in reversed(range(MINING_ROUNDS + 1)):
        names = sorted(words)
        x = np.stack([kernel.weighted(names, table([(1.0, f)])) for f in phi], axis=1) @ root
        seen = np.array([words[n] for n in names], float)
        w, bias = linear_svm(np.vstack([x, x]), np.repeat([1.0, -1.0], len(names)), np.concatenate([seen[:, 0], seen[:, 1]]))
        weights = table(zip(root @ w, phi))
        if left:  # the clean words that rank highest are learned next
            ranked = _figures(clean_words.select("word", "toxic", "clean", F.regexp_replace("word", r"^\^", "").alias("text")), weights, bias, "text", drop_text=True)
            words |= taken(ranked.orderBy(F.desc(F.col("__f")[0]), "word").limit(TRAIN_WORDS // 6))

    figures = _figures(train, weights, bias, text_col, drop_text=True).select("__f", "__label").toPandas()  # at most sample_docs rows
    slopes, shift = logistic(np.array(figures["__f"].tolist(), float), figures["__label"].to_numpy(float))
    return Model(weights, bias, slopes, shift, share)


def linear_svm(x: np.ndarray, y: np.ndarray, counts: np.ndarray, penalty: float = 1e-4, steps: int = 100) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss and balanced classes, by Newton steps on the support."""
    rows = counts > 0
    x, y, counts = x[rows], y[rows], counts[rows]
    weight = np.where(y > 0, counts / max(1.0, counts[y > 0].sum()), counts / max(1.0, counts[y < 0].sum())) / 2
    a = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    ridge = penalty * np.eye(a.shape[1])
    ridge[-1, -1] = 1e-9
    w, support = np.zeros(a.shape[1]), None
    for _ in range(steps):
        now = y * (a @ w) < 1
        if support is not None and np.array_equal(now, support):
            break
        support = now
        b = a[support] * weight[support, None]
        w = np.linalg.solve(b.T @ a[support] + ridge, b.T @ y[support])
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> tuple[list[float], float]:
    """Slopes and shift of a logistic curve over figures, fitted on their standardised values; figures that hardly
    vary in training hardly count."""
    mean, spread = x.mean(0), np.maximum(x.std(0), 0.1)
    a, p = np.hstack([(x - mean) / spread, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(a @ p, -30, 30)))
        step = np.linalg.solve((a * (q * (1 - q) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(p)), a.T @ (q - y) + ridge * p)
        p = p - step
        if np.abs(step).max() < 1e-9:
            break
    slopes = p[:-1] / spread
    return slopes.tolist(), float(p[-1] - slopes @ mean)


def _figures(docs: DataFrame, weights: np.ndarray, bias: float, text_col: str, drop_text: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        figures = word_scorer(shared.value, bias)

        def one(text):
            return (figures(text),)

        one.prepare = figures.prepare
        return one

    return add_columns(docs, text_col, make, "__f array<double>", drop_source=drop_text)


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with __score, from 0 to 1."""
    if model.weights is None:
        out = docs.withColumn("__score", F.lit(float(model.share)))
        return out if keep_text else out.drop(text_col)
    scored = _figures(docs, model.weights, model.bias, text_col, drop_text=not keep_text)
    power = F.lit(model.shift)
    for i, slope in enumerate(model.slopes):
        power = power + F.col("__f")[i] * slope
    power = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), power))
    return scored.withColumn("__score", 1 / (1 + F.exp(-power))).drop("__f")


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted), one row per document."""
    model = fit(docs, labels, id_col, text_col)
    out = with_scores(docs.select(id_col, text_col), model, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below one half."""
    return with_scores(docs, model, text_col, keep_text=True).filter("__score < 0.5").select(*docs.columns)
