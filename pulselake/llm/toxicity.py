"""Toxicity by gradient-boosted trees over a few dense features, calibrated isotonically.

The lexicon is learnt: words and word pieces that stand out in toxic labelled texts. Scored
are densities of lexicon hits, their nearness to second-person words, rates of capitals and
punctuation, and hits that only show once letters replaced by digits or signs are restored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import moved
from .common import Scratch, apart, named, small_batches
from .learning import calibrated, held_out, training_rows, with_decision

THRESHOLD = 0.7
BEGINNING, PIECE = range(4, 10), 5
#: Lexicon entries; least log-odds of an entry, and least log-odds in standard errors.
LEXICON, LEAST_ODDS, LEAST_Z = 1_500, 2.5, 2.8
TREES, DEPTH, STEP = 15, 3, 0.3
NEAR = 5
# Second-person words of the four languages, and what stands for a letter.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes "
    "vous votre vos ti tú usted ustedes vosotros tus".split())
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a",
                          "$": "s", "!": "i", "|": "l", "*": None, ".": None, "-": None,
                          "_": None, "+": "t"})
MIXED = re.compile(r"\b\w*[^\W\d_](?:[@$!|*+_]|\d|[.-](?=[^\W\d_]))+\w[\w@$!|*+.-]*")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?!\w)")
WORDS = re.compile(r"[^\W\d_]+")


def _entries(text: str) -> set[str]:
    """What a lexicon can hold of a text: words (a blank on either side), beginnings of words
    (a blank before), and pieces from anywhere in a word."""
    words = set(WORDS.findall(text.lower()))
    out = {f" {w} " for w in words}
    for word in words:
        out.update(f" {word[:n]}" for n in BEGINNING if n < len(word))
        out.update(word[i:i + PIECE] for i in range(len(word) - PIECE + 1))
    return out


def learn_lexicon(training: DataFrame) -> list[tuple[str, float]]:
    """Entries whose odds to occur in a toxic text are far above those in a clean one, with
    their log-odds in standard errors as weights. The texts are the bounded sample; counts are
    added up per task and by Spark."""
    learnt = training.where("not calibrates")
    sizes = dict(learnt.groupBy("label").count().collect())
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(), Counter()
            for text, label in zip(*(c.to_pylist() for c in batch.columns)):
                counts[label].update(_entries(text))
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([counts[1][x] for x in names], pa.int64()),
                 pa.array([counts[0][x] for x in names], pa.int64())],
                names=["entry", "toxic", "clean"])

    counted = learnt.select("text", "label").mapInArrow(
        run, "entry string, toxic bigint, clean bigint").groupBy("entry").agg(
            F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic >= 3")
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (n_toxic + 1 - a)) - F.log(b / (n_clean + 1 - b))
    ranked = counted.withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / a + 1 / b)).where(
        (F.col("odds") >= LEAST_ODDS) & (F.col("z") >= LEAST_Z))
    return [(r.entry, r.z) for r in ranked.orderBy(F.desc("z"), "entry").limit(LEXICON).collect()]


class Features:
    def __init__(self, lexicon: list[tuple[str, float]]):
        self.entries = ahocorasick.Automaton()
        for entry, weight in lexicon:
            kind = 0 if entry.endswith(" ") else 1 if entry.startswith(" ") else 2
            self.entries.add_word(entry, (kind, len(entry), weight))
        self.empty = not lexicon
        if lexicon:
            self.entries.make_automaton()

    def hits(self, words: list[str]) -> tuple[dict[int, int], dict[int, float]]:
        """By place, of the words that are (0), begin with (1) or hold (2) a lexicon entry:
        the kind of the closest match and the largest weight."""
        kinds: dict[int, int] = {}
        weights: dict[int, float] = {}
        if not self.empty:
            starts: list[int] = []
            for end, (kind, size, weight) in self.entries.iter(" " + " ".join(words) + " "):
                if not starts:
                    at = 0
                    for word in words:
                        starts.append(at)
                        at += len(word) + 1
                place = bisect_right(starts, end - size + 1) - 1
                kinds[place] = min(kind, kinds.get(place, kind))
                weights[place] = max(weight, weights.get(place, weight))
        return kinds, weights

    def of(self, text: str) -> list[float]:
        lower = text.lower()
        words = WORDS.findall(lower)
        n, chars = max(1, len(words)), max(1, len(text))
        kinds, weights = self.hits(words)
        whole, begun, held = ([i for i, k in kinds.items() if k == kind] for kind in range(3))
        at = sorted([*whole, *begun])
        persons = [i for i, w in enumerate(words) if w in SECOND_PERSON] if at else []
        near = 0
        for i in at if persons else []:
            j = bisect_right(persons, i)
            near += min(abs(p - i) for p in persons[max(0, j - 1):j + 1]) <= NEAR
        mixed = MIXED.findall(lower) + SPACED.findall(lower)
        plain = [m.replace(" ", "").translate(DISGUISE) for m in mixed]
        shown = len(self.hits(WORDS.findall(" ".join(plain)))[0]) if plain else 0
        weight = sum(weights.values())
        upper = sum(map(str.isupper, text)) if text != lower else 0
        return [weight / n, math.log1p(weight), max(weights.values(), default=0.0), len(whole) / n, math.log1p(len(whole)), len(begun) / n, math.log1p(len(begun)),
                len(held) / n, math.log1p(len(held)), near / n, len(persons) / n,
                upper / max(1, sum(map(len, words))),
                sum(map(str.isupper, text.split())) / n if upper else 0.0,
                text.count("!") / n, text.count("?") / n, sum(map(text.count, "!?.,;:")) / chars,
                (text.count("!!") + text.count("??")) / n, len(mixed) / n, shown / n]


def featurize(docs: DataFrame, lexicon: list[tuple[str, float]], keep: list[str]) -> DataFrame:
    """The ``keep`` columns and ``features`` of whole texts."""
    small_batches(docs.sparkSession, 2000)
    rows = docs.select(*keep, "text")
    kinds = T.StructType([*rows.drop("text").schema.fields,
                          T.StructField("values", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lexicon)
        for batch in batches:
            values = [features.of(t or "") for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(values, pa.list_(pa.float64()))],
                names=[*keep, "values"])

    return rows.mapInArrow(run, kinds).withColumn("features", array_to_vector("values")).drop("values")


def scored_rows(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """``doc``, a struct of all columns of ``docs`` whatever their names, and ``score``.

    Null and empty texts have features of 0 and are scored by them. Unless both labels occur
    among the learnt rows, the score is 0 throughout: nothing is known to be toxic. Repeated
    rows are scored alike.
    """
    docs = apart(docs)
    labels = moved(labels, docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("doc"), "text")
    training = training_rows(docs, labels, "toxic", held_out(modulus, remainder), scratch)
    if training is None:
        return rows.select("doc", F.lit(0.0).alias("score"))
    lexicon = learn_lexicon(training)
    known = scratch.keep(featurize(training, lexicon, ["label", "calibrates"]), "known")
    fold = known.where("not calibrates")
    fold = fold if fold.agg(F.countDistinct("label")).first()[0] == 2 else known
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH,
                          stepSize=STEP, seed=7).fit(fold.coalesce(4))

    def probability(df: DataFrame) -> DataFrame:
        return trees.transform(df).withColumn("toxic_odds", vector_to_array("probability")[1])

    return calibrated(probability(featurize(rows, lexicon, ["doc"])), probability(known),
                      "toxic_odds").select("doc", "score")


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1,
                    threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``; see
    ``scored_rows``. Columns but doc_id and text are not looked at."""
    scored = scored_rows(docs.select("doc_id", "text"), labels, modulus, remainder)
    return with_decision(scored.select("doc.doc_id", "score"), modulus, remainder, threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score stays below ``threshold``, with all their columns."""
    return scored_rows(docs, labels).where(F.col("score") < threshold).select("doc.*")
