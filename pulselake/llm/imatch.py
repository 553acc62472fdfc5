"""Document fingerprints by I-Match over randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency lies within a band: neither so
common that they say little nor so rare that one misprint changes the fingerprint. Its subsets
come in ``FAMILIES`` families of nested ones: subset l of a family holds each term with
probability 2^-l, by the leading zeros of a piece of the term's hash. Of each family a text is
hashed over the sparsest subset that still holds one of its terms: its distinct terms there,
sorted and joined. So a short and a long text both meet subsets in which a partial edit leaves
them unchanged, and two fingerprints agree in about as many families as the texts share terms.

A term of the band is in at least ``LEAST`` of 1,000 texts, so the lexicon is no larger than
1,000 / ``LEAST`` times the mean number of distinct terms in a text, however many texts there
are; that many terms are sent to all tasks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of
from .resample import FOLDED

#: The band: texts in 1,000 that hold a term.
LEAST, MOST = 1, 100
FAMILIES = 32
PIECES = 16  # of 16 bits, in one sha256
HEX = 4
#: A task counts so many terms before it sends them on.
COUNTED = 500_000
#: Documents in a bin of the order by doc_id, the most bins, and sampled keys to a bin.
BIN_ROWS, MOST_BINS, KEYS = 1_000, 20_000, 16

BITS = np.array([v.bit_length() for v in range(1 << 16)], np.uint8)


def terms_of(text: str) -> set[bytes]:
    """Runs of ASCII letters (in lower case) and digits and of anything beyond ASCII."""
    return set(text.encode().translate(FOLDED).split(b" ")) - {b""}


def levels(terms: list[bytes]) -> np.ndarray:
    """Up to which subset of each family the terms belong, a row for each term."""
    digests = b"".join(hashlib.sha256(b"%d:%b" % (k, term)).digest()
                       for term in terms for k in range(FAMILIES // PIECES))
    return 16 - BITS[np.frombuffer(digests, ">u2").reshape(len(terms), FAMILIES)]


class Lexicon:
    """``terms`` in the order of their bytes."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        self.index = {term: i for i, term in enumerate(terms)}
        self.levels = levels(terms)

    def fingerprint(self, text: str) -> str:
        """A hash of all terms of the lexicon in ``text``, then one for each family."""
        found = terms_of(text)
        known = sorted(i for i in map(self.index.get, found) if i is not None)
        if known:
            terms, level = [self.terms[i] for i in known], self.levels[known]
        else:
            terms = sorted(found) or [text.encode()]
            level = levels(terms)
        family, member = np.nonzero((level == level.max(axis=0)).T)
        bounds = np.searchsorted(family, np.arange(FAMILIES + 1)).tolist()
        member = member.tolist()
        out = [hashlib.md5(b" ".join(terms)).hexdigest()[:16], ":"]
        for begin, end in zip(bounds, bounds[1:]):
            subset = b" ".join([terms[i] for i in member[begin:end]])
            out.append(hashlib.md5(subset).hexdigest()[:HEX])
        return "".join(out)


def likeness(a: str, b: str) -> float:
    """The share of families in which two fingerprints agree."""
    a, b = a[17:], b[17:]
    return sum(a[i:i + HEX] == b[i:i + HEX] for i in range(0, len(a), HEX)) / FAMILIES


@lru_cache(1)
def _loaded(key: str, sent: Broadcast) -> Lexicon:
    return Lexicon(sent.value.split(b" ") if sent.value else [])


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``(term, n)``: in how many rows' ``text`` a term occurs."""
    def rows(counted: Counter) -> pa.RecordBatch:
        terms = sorted(counted)  # neighbours that begin alike are shuffled in less space
        return pa.RecordBatch.from_arrays([pa.array([t.decode() for t in terms], pa.string()),
                                           pa.array([counted[t] for t in terms], pa.int64())], ["term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counted.update(terms_of(text.as_py()))
                if len(counted) >= COUNTED:
                    yield rows(counted)
                    counted.clear()
        yield rows(counted)

    return docs.select(text_of()).mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def band(frequencies: DataFrame, texts: int, least: int = LEAST, most: int = MOST) -> DataFrame:
    """The terms that at least ``least`` and at most ``most`` in 1,000 texts hold."""
    return frequencies.where((1000 * F.col("n") >= least * texts) & (1000 * F.col("n") <= most * texts)).select("term")


def _bins(keys: DataFrame, rows: int) -> list[tuple]:
    """Where the bins of the order by ``keys`` begin, from a sample; they need not be even."""
    bins = min(MOST_BINS, rows // BIN_ROWS + 1)
    sample = keys.sample(min(1.0, KEYS * bins / max(rows, 1)), seed=13).collect()
    found = sorted((doc is not None, doc or 0, tie) for doc, tie in sample)
    return sorted(set(found[KEYS::KEYS]))


def _places(starts: list[tuple], firsts: dict[tuple, int]) -> Column:
    """The bin of a row, and for a row in ``firsts`` also the bin before it."""
    def run(doc: pd.Series, tie: pd.Series) -> pd.Series:
        keys = [(d is not None, int(d or 0), t) for d, t in zip(doc, tie)]
        return pd.Series([[bisect_right(starts, k), *([firsts[k]] if k in firsts else [])] for k in keys])
    run.__annotations__ = {"doc": pd.Series, "tie": pd.Series, "return": pd.Series}
    # The id as text: pandas would make numbers with nulls floats.
    return F.pandas_udf(run, "array<int>")(F.col("doc_id").cast("string"), F.col("tie"))


def fingerprints(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of the whole text of every row of ``docs``. Equal texts have
    equal fingerprints. A text without terms in the band is hashed over all its terms, one without
    any terms as a whole; a null text is empty. Repeated rows are rows of their own, null ids stay,
    other columns are dropped, an empty table gives none. No text is shuffled."""
    sent, key = _sent_lexicon(docs, least, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _loaded(key, sent)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [lexicon.fingerprint(text.as_py()) for text in batch.column(1)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(
        run, "doc_id bigint, fingerprint string")


def _sent_lexicon(docs: DataFrame, least: int, most: int) -> tuple[Broadcast, str]:
    """Bounded as the module says."""
    terms = sorted(r.term.encode() for r in band(document_frequencies(docs), docs.count(), least, most).collect())
    packed = b" ".join(terms)
    return docs.sparkSession.sparkContext.broadcast(packed), hashlib.md5(packed).hexdigest()


def followed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as ``bin``, ``guest``, ``doc_id``, ``text``, dealt and sorted so that
    each row is followed by the next in ascending order of doc_id (nulls first, ties by the md5 of
    the text). Each bin ends with a copy of the next one's first row, marked ``guest``; the last
    ends with the first row of all. One shuffle of the texts; any row count, ids as they like."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).withColumn("tie", F.md5("text"))
    keys = scratch.keep(rows.select("doc_id", "tie"), "keys")
    starts = _bins(keys, keys.count())
    # At most one row per bin.
    first = sorted((r.bin, (r.key.doc_id is not None, r.key.doc_id or 0, r.key.tie)) for r in keys.groupBy(
        _places(starts, {})[0].alias("bin")).agg(F.min(F.struct("doc_id", "tie")).alias("key")).collect())
    scratch.drop(keys)
    firsts = {key: before for (_, key), (before, _) in zip(first, first[-1:] + first[:-1])}
    return (rows.select("*", F.posexplode(_places(starts, firsts)).alias("guest", "bin"))
            .select("bin", (F.col("guest") > 0).alias("guest"), "doc_id", "text", "tie")
            .repartitionById(len(starts) + 1, F.col("bin"))
            .sortWithinPartitions("bin", "guest", F.col("doc_id").asc_nulls_first(), "tie").drop("tie"))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """How fingerprints of all documents fare under an edit: ``doc_id``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``. A single row is followed
    by itself. Else as ``fingerprints``."""
    sent, key = _sent_lexicon(docs, LEAST, MOST)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, last = _loaded(key, sent), None
        for batch in batches:
            out = []
            for bin_, guest, doc, text in zip(*[batch.column(i) for i in range(4)]):
                bin_, guest, doc, text = bin_.as_py(), guest.as_py(), doc.as_py(), text.as_py()
                if guest and (last is None or last[0] != bin_ or last[1]):
                    continue  # one guest to a bin
                now = lexicon.fingerprint(text)
                if last and last[0] == bin_:
                    _, _, before, said, own = last
                    changed = edited(said, text)
                    other = lexicon.fingerprint(changed)
                    out.append((before, len(said), hashlib.sha256(changed.encode()).hexdigest(), own, other,
                                likeness(own, other), likeness(own, now)))
                last = (bin_, guest, doc, text, now)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 7, schema)], schema=schema)

    return followed(docs).mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")
