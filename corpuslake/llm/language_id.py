"""Language identification in two steps: the family, then one-versus-one linear SVMs within it.

The family is the one whose linear SVM (against all other families) has the largest margin, so the
classifiers are as many as the families and the pairs inside them.

Features of a whole text: hashed byte n-grams (one to three bytes) of the lower-cased text and
hashed words, each as a share of the text's n-grams. A learned language that FAMILIES does not name
is a family of its own. The SVMs minimise hinge loss and an L2 penalty by subgradient steps; their
weights are the average over all steps.

Fitting uses a bounded sample of each language, SAMPLE_ROWS rows of SAMPLE_BYTES of text or about so
many, taken by a hash of doc_id and text; a language of which the hash takes no row gives the row of
least hash, so none is without. The rows stream through the tasks EPOCHS times in different orders;
a task trains TASK_CLASSIFIERS at most, and holds these only. Every document is predicted.

Cases: a null text, or one without a letter, is `und` with score 0; rows with a null language are
not learned from; a single learned language is predicted for all, with score 1; with none, all are
`und`; repeated rows are predicted each; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.quality_classifier import is_held_out
from corpuslake.llm.textbatch import Texts, segment_sums, slices

CELLS = 1 << 16
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 8 << 20
#: Classifiers that one task trains (1.5 MB each).
TASK_CLASSIFIERS = 64
EPOCHS = 3
RATE, PENALTY = 0.1, 1e-5
SCALE = 30.0
U = np.uint64

#: Families by ISO 639-1 code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "hr", "sr", "sl"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def features(column: pa.Array, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all n-grams, text by text, and how many each text has. `column` is lower-cased here."""
    texts = Texts(pc.utf8_lower(column))
    size = np.diff(texts.at)
    owner = np.repeat(np.arange(texts.n, dtype=np.int32), size)
    data = texts.data.astype(U)
    parts, owners, gram = [(texts.words() + U(3)) % U(cells)], [texts.owner.astype(np.int32)], np.zeros(len(data), U)
    for n in range(1, 4):
        if len(data) < n:
            break
        gram = gram[: len(data) - n + 1] * U(257) + data[n - 1 :] + U(1)
        inside = owner[: len(gram)] == owner[n - 1 :]
        parts.append(((gram[inside] * U(0x9E3779B97F4A7C15)) >> U(48)) % U(cells))
        owners.append(owner[: len(gram)][inside])
    who = np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return np.concatenate(parts).astype(np.int32)[order], np.bincount(who, minlength=texts.n)


class Svm:
    """Linear SVM: hinge loss and L2 penalty, subgradient steps with per-coordinate rates, averaged weights.

    The penalty shrinks every weight by the same factor each step, kept apart as `scale`: the weights are
    scale * w. Their sum over steps is tracked at changes only: it is total + done * w, where `done` is the
    sum of scales so far."""

    def __init__(self, cells: int):
        self.w, self.g2, self.total = np.zeros(cells), np.full(cells, 1e-8), np.zeros(cells)
        self.scale, self.done, self.steps = 1.0, 0.0, 0

    def learn(self, at: np.ndarray, values: np.ndarray, sign: int) -> None:
        self.scale *= 1 - RATE * PENALTY
        if sign * self.scale * (self.w[at] @ values) < 1:
            g = -sign * values
            self.g2[at] += g * g
            change = -RATE * g / np.sqrt(self.g2[at]) / self.scale
            self.w[at] += change
            self.total[at] -= self.done * change
        self.done += self.scale
        self.steps += 1

    def average(self) -> np.ndarray:
        return (self.total + self.done * self.w) / max(self.steps, 1)


def classifiers(langs: list[str]) -> list[tuple[str, str]]:
    """What is separated: each family from all others ("family", name), then the pairs of languages within families.

    Of two families the first against the second is enough."""
    families = sorted({family_of(x) for x in langs})
    found = [("family", x) for x in (families if len(families) > 2 else families[:-1])]
    for family in families:
        found += combinations(sorted(x for x in langs if family_of(x) == family), 2)
    return found


def side(classifier: tuple[str, str], lang: str) -> int:
    """1 or -1 for the sides of a classifier that a language is on, 0 if on neither."""
    first, second = classifier
    if first == "family":
        return 1 if family_of(lang) == second else -1
    return (lang == first) - (lang == second)


def fitted(docs: DataFrame, cells: int = CELLS, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """Languages, and one row of weights (the bias last) for each of classifiers(languages)."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    rows = rows.withColumn("hash", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"), F.min("hash").alias("least")).collect()  # a row a language
    bounds = {r["lang"]: int((1 << 32) * min(1.0, sample_rows / r["rows"], sample_bytes / max(r["bytes"], 1))) for r in sizes}
    langs = sorted(bounds)
    found = classifiers(langs)
    if not found:
        return langs, np.zeros((0, cells + 1), np.float32)
    bound = F.create_map(*[F.lit(x) for lang in langs for x in (lang, bounds[lang])])
    sample = rows.filter(F.col("hash") < bound[F.col("lang")]).select("doc_id", "text", "lang")
    if without := [r["lang"] for r in sizes if r["least"] >= bounds[r["lang"]]]:
        first = rows.filter(F.col("lang").isin(without)).groupBy("lang").agg(F.min_by(F.struct("doc_id", "text"), "hash").alias("r"))
        sample = sample.unionByName(first.select("r.doc_id", "r.text", "lang"))
    each = TASK_CLASSIFIERS
    groups = -(-len(found) // each)
    sides = {lang: [(k, s) for k, c in enumerate(found) if (s := side(c, lang))] for lang in langs}

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[int, Svm] = {}
        now = -1

        def done() -> Iterator[pa.RecordBatch]:
            for k, model in models.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([model.average().astype(np.float32).tobytes()], pa.binary())], ["k", "w"])

        for batch in batches:
            for first, part in slices(batch.column("text")):
                hashed, n = features(part, cells)
                ends = np.cumsum(n)
                keys = zip(*[batch.column(c).slice(first, len(part)).to_pylist() for c in ("lang", "group")], strict=True)
                for i, (lang, group) in enumerate(keys):
                    if group != now:
                        yield from done()
                        now, models = group, {k: Svm(cells + 1) for k in range(group * each, min((group + 1) * each, len(found)))}
                    at, count = np.unique(hashed[ends[i] - n[i] : ends[i]], return_counts=True)
                    at, values = np.append(at, cells), np.append(SCALE * count / max(n[i], 1), 1.0)
                    for k, s in sides[lang]:
                        if k in models:
                            models[k].learn(at, values, s)
        yield from done()

    which = F.create_map(*[F.lit(x) for lang in langs for x in (lang, ",".join(map(str, sorted({k // each for k, _ in sides[lang]}))))])
    passes = sample.select("text", "lang", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))).alias("epoch"), "doc_id")
    passes = passes.withColumn("group", F.explode(F.split(which[F.col("lang")], ",").cast("array<int>")))
    ordered = passes.withColumn("turn", F.xxhash64("doc_id", "epoch")).repartition(groups, "group").sortWithinPartitions("group", "epoch", "turn", "text", "lang")
    table = np.zeros((len(found), cells + 1), np.float32)
    for row in ordered.select("text", "lang", "group").mapInArrow(train, "k int, w binary").toLocalIterator():
        table[row["k"]] = np.frombuffer(row["w"], np.float32)
    return langs, table


def decide(margins: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each row of margins (one column per classifier).

    The family with the largest margin, then the language of it with the most one-versus-one wins; of
    equal ones the surer, then the first by name. The score is the family's probability times the
    winner's weakest win."""
    place = {c: k for k, c in enumerate(classifiers(langs))}
    sure = 1.0 / (1.0 + np.exp(-np.clip(margins, -35, 35)))
    families = sorted({family_of(x) for x in langs})
    best, score = np.zeros(len(margins), np.int64), np.ones(len(margins))
    if len(families) > 1:
        columns = [place["family", x] for x in families if ("family", x) in place]
        of_family, p = margins[:, columns], sure[:, columns]
        if len(families) == 2:
            of_family, p = np.hstack([of_family, -of_family]), np.hstack([p, 1 - p])
        best = np.argmax(of_family, axis=1)
        score = p[np.arange(len(margins)), best]
    out = np.empty(len(margins), object)
    for k, name in enumerate(families):
        mine, inside = best == k, sorted(x for x in langs if family_of(x) == name)
        wins, least = np.zeros((mine.sum(), len(inside))), np.ones((mine.sum(), len(inside)))
        for (i, a), (j, b) in combinations(enumerate(inside), 2):
            p = sure[mine, place[a, b]]
            wins[:, i] += (p >= 0.5) + p * 1e-3
            wins[:, j] += (p < 0.5) + (1 - p) * 1e-3
            least[:, i], least[:, j] = np.minimum(least[:, i], p), np.minimum(least[:, j], 1 - p)
        winner = np.argmax(wins, axis=1)
        out[mine] = np.array(inside, object)[winner]
        score[mine] *= least[np.arange(len(winner)), winner]
    return out, score


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predicted(docs: DataFrame, langs: list[str], table: np.ndarray, cells: int = CELLS) -> DataFrame:
    """doc_id, lang_pred, score for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for first, part in slices(batch.column("text")):
                lettered = np.fromiter((has_letter(t.as_py()) for t in part), bool, len(part))
                if langs:
                    found, n = features(part, cells)
                    margins = np.zeros((len(part), len(weights)))
                    for k, w in enumerate(weights):
                        margins[:, k] = SCALE * segment_sums(w[found], n) / np.maximum(n, 1) + w[-1]
                    names, score = decide(margins, langs)
                    names, score = np.where(lettered, names, "und"), np.where(lettered, score, 0.0)
                else:
                    names, score = np.full(len(part), "und", object), np.zeros(len(part))
                ids = batch.column("doc_id").slice(first, len(part))
                yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out."""
    langs, table = fitted(docs.filter(~is_held_out("doc_id", 4, 2)))
    out = predicted(docs, langs, table)
    return out.select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
