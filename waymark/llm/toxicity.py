"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded whole texts.

Folding: compatibility decomposition without marks and invisible characters, lower case, letters of other scripts that look
like Latin ones as those, digits and signs that stand for letters as these where they touch a letter, i and l as one letter,
all else as single spaces. ``1d10t``, ``ідіот`` (Cyrillic) and ``Idiot!`` fold alike.

A term is a whole word or the beginning of words (written with a star). Of the terms that begin at one place the heaviest
counts (the longest of equals), unless an exception phrase covers it. A text's evidence is the sum of the weights over the square root of its number
of words, and its score a logistic function of that.

Training counts in how many labelled texts of each class each word and each beginning of words occurs. Terms whose excess
in toxic texts is significant after correction for the number of terms tried are weighted by their log-odds; of terms that
contain each other the most significant stays. Words and pairs of words around matches that are no likelier in toxic texts become
exceptions, the commonest first. Slope and intercept are fitted to a histogram of evidence.

Null and empty texts have no evidence and get the score of such texts. Texts are never cut. Labels that are null, or of ids that
are null, are passed over; an id with several labels is toxic if half of them are. Without labelled rows of both classes the
lexicon is empty and every score is 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import discard, free_name, small_batches, written

# Letters that look like Latin ones, by script, and signs that stand for letters.
CYRILLIC = dict(zip("аәвгеёєзіїйкмноөрсѕтухһьѵјԁԛԝҍ", "aabreeeeiiikmhoopcstyxhbvjdqwb", strict=True))
GREEK = dict(zip("αβγδεζηικλμνοπρςστυφχωϲϳ", "abydezniklmvonpcotuoxwcj", strict=True))
OTHER = {"ı": "i", "ɩ": "i", "ⅼ": "l", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ƅ": "b", "ɑ": "a", "ɡ": "g", "ʋ": "u", "ѡ": "w", "ա": "w", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "æ": "ae", "œ": "oe"}
SIGNS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

#: Lengths of the beginnings of words that are tried as terms.
BEGINNINGS = range(4, 11)
#: Documented bounds: labelled texts of each class, terms and exceptions.
SAMPLE_TEXTS, MAX_TERMS, MAX_EXCEPTIONS = 10_000, 4096, 4096
#: The chance that a lexicon learnt from labels without meaning has any term.
ERROR = 0.05
#: Times that exceptions are looked for, each time beside those found.
ROUNDS = 4
_BINS_A_UNIT, _MAX_EVIDENCE = 100, 50.0

_ASCII = bytes(
    (ord("i") if chr(c) in "lL" else c | 32) if 65 <= c <= 90 or 97 <= c <= 122 else c if chr(c) in SIGNS else 32 for c in range(256)
)
_LOOKS = {ord(a): b for table in (CYRILLIC, GREEK, OTHER) for a, b in table.items()}
_STANDS = re.compile(r"(?<=[a-z])[0-9@$!]+(?=[a-z])|[0-9@$]+(?=[a-z])|(?<=[a-z])[0-9@$]+")
_GAPS = re.compile(r"[\W\d_]+")
_SIGN_TABLE = str.maketrans(SIGNS)


class _Plain(dict):
    """Characters of decomposed text: marks and invisible ones go, look-alikes become Latin."""

    def __missing__(self, code: int):
        c = chr(code)
        out = "" if unicodedata.category(c) in ("Mn", "Me", "Cf") else _LOOKS.get(code, c)
        self[code] = out
        return out


_PLAIN = _Plain()


def fold(text: str | None) -> str:
    """The folded words between single spaces, one also at either end; a single space if there is none."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).lower()).translate(_PLAIN)
    if text.isascii():
        text = text.encode().translate(_ASCII).decode()
    else:
        text = text.replace("l", "i")
    text = _STANDS.sub(lambda m: m[0].translate(_SIGN_TABLE), text)
    words = _GAPS.sub(" ", text).split()
    return f" {' '.join(words)} " if words else " "


def term(entry: str) -> str:
    """An entry of a lexicon (``idiot``, ``scum*``, ``trash can``) as it is looked for in folded texts."""
    return fold(entry[:-1]).rstrip(" ") if entry.endswith("*") else fold(entry)


@dataclass(frozen=True)
class Lexicon:
    """Weights by folded term, folded exception phrases, and the logistic function of the evidence."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    slope: float = 1.0
    intercept: float = -math.inf

    @classmethod
    def of(cls, entries: dict[str, float], exceptions: Iterable[str] = (), slope: float = 1.0, intercept: float = -3.0) -> Lexicon:
        """A lexicon written by hand; entries that fold to nothing are left out."""
        weights = {term(e): w for e, w in entries.items() if term(e).strip()}
        return cls(weights, frozenset(t for e in exceptions if (t := term(e)).strip()), slope, intercept)


class Matcher:
    """The automaton of one worker."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in {*lexicon.weights, *lexicon.exceptions}:
            self.automaton.add_word(phrase, (len(phrase), lexicon.weights.get(phrase), phrase in lexicon.exceptions))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the heaviest term at each place that no exception covers."""
        if not len(self.automaton):
            return []
        found, shields = {}, []
        for last, (length, weight, shield) in self.automaton.iter(folded):
            start = last + 1 - length
            if shield:
                shields.append((start, last + 1))
            if weight is not None and (start not in found or found[start][1] <= weight):
                found[start] = (last + 1, weight)
        if not shields:
            return [(start, end, weight) for start, (end, weight) in found.items()]
        # of the exceptions that begin up to a place the one that reaches farthest covers most
        shields.sort()
        begins, reach = [s for s, _ in shields], np.maximum.accumulate([e for _, e in shields])
        at = np.searchsorted(begins, list(found), side="right") - 1
        return [(s, e, w) for (s, (e, w)), i in zip(found.items(), at.tolist(), strict=True) if i < 0 or reach[i] < e]

    def evidence(self, folded: str) -> tuple[float, int, int]:
        """(evidence, matches, words)."""
        found, words = self.matches(folded), max(0, folded.count(" ") - 1)
        return (sum(w for _, _, w in found) / math.sqrt(words) if words else 0.0), len(found), words


def evidence(text: Column, lexicon: Lexicon, folded: bool = False) -> Column:
    """A struct (evidence, n_matches, n_words) of each whole text."""
    small_batches()

    @F.arrow_udf("evidence double, n_matches long, n_words long")
    def weighed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(lexicon)
        for texts in batches:
            rows = [matcher.evidence((t.as_py() or " ") if folded else fold(t.as_py())) for t in texts]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["evidence", "n_matches", "n_words"])

    return weighed(text)


def _folded(text: Column) -> Column:
    @F.arrow_udf("string")
    def each(texts: pa.Array) -> pa.Array:
        return pa.array([fold(t.as_py()) for t in texts], pa.string())

    return each(text)


def _terms(folded: Column) -> Column:
    """The different words of a text and their beginnings."""

    @F.arrow_udf("array<string>")
    def each(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            words = set(t.as_py().split())
            out.append([f" {w} " for w in words] + list({f" {w[:n]}" for w in words for n in BEGINNINGS if n < len(w)}))
        return pa.array(out, pa.list_(pa.string()))

    return each(folded)


def _contexts(folded: Column, lexicon: Lexicon) -> Column:
    """The different words and pairs of words around the matches of a text."""

    @F.arrow_udf("array<string>")
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(lexicon)
        for texts in batches:
            out = []
            for t in texts:
                s, seen = t.as_py(), set()
                for start, end, _ in matcher.matches(s):
                    end = s.index(" ", end - 1) + 1
                    before, after = s.rfind(" ", 0, start), s.find(" ", end)
                    word = s[start:end]
                    if word not in lexicon.weights:
                        seen.add(word)
                    if before >= 0:
                        seen.add(s[before:end])
                    if after >= 0:
                        seen.add(s[start : after + 1])
                out.append(list(seen))
            yield pa.array(out, pa.list_(pa.string()))

    return each(folded)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, toxic: str, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """(rows (y, folded), labelled ids by class): about ``sample`` labelled ids of each class, by hash of the id."""
    y = (F.avg(F.col(toxic).cast("double")) >= 0.5).cast("int").alias("y")
    known = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(key).alias("id")).agg(y)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = F.shiftrightunsigned(F.xxhash64("id", F.lit(12)), 11) / F.lit(float(2**53))
    share = F.lit(0.0)
    for c, n in counts.items():
        share = F.when(F.col("y") == c, F.lit(min(1.0, sample / n))).otherwise(share)
    picked = F.broadcast(known.where(part < share))  # about ``sample`` ids of each class, whatever the size of the table
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(picked, "id")
    return written(rows.select("y", _folded(F.col("text")).alias("folded")), "labelled"), counts


def _excess(n1: Column, n0: Column, all1: int, all0: int) -> tuple[Column, Column]:
    """(log-odds, G statistic) of a term that n1 of all1 toxic and n0 of all0 other texts have."""
    odds = F.log((n1 + 0.5) / (all1 + 1.0)) - F.log((n0 + 0.5) / (all0 + 1.0))

    def part(n: Column, of: Column, share: float) -> Column:
        return F.when(n > 0, n * F.log(n / (of * share))).otherwise(0.0)

    has, share = n1 + n0, all1 / (all1 + all0)
    lacks = F.lit(all1 + all0) - has
    g = part(n1, has, share) + part(n0, has, 1 - share) + part(F.lit(all1) - n1, lacks, share) + part(F.lit(all0) - n0, lacks, 1 - share)
    return odds, 2 * g


def _counted(rows: DataFrame, phrases: Column) -> DataFrame:
    each = rows.select("y", F.explode(phrases).alias("phrase"))
    return each.groupBy("phrase").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))


def fit(evidence_bins: Iterable[tuple[float, float, float]], steps: int = 60) -> tuple[float, float]:
    """(slope, intercept) of the logistic function for (evidence, weight of toxic, weight of others), lightly regularised."""
    x, toxic, other = (np.array(c, np.float64) for c in zip(*evidence_bins, strict=True))
    total, at = toxic + other, np.array([0.0, 0.0])
    pull = np.diag([1e-3, 1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -30, 30)))
        miss, v = toxic - total * p, total * p * (1 - p)
        gradient = np.array([(miss * x).sum(), miss.sum()]) - pull @ at
        step = np.linalg.solve(np.array([[(v * x * x).sum(), (v * x).sum()], [(v * x).sum(), v.sum()]]) + pull, gradient)
        at += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(0.0, at[0])), float(at[1])


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE_TEXTS, exceptions: Iterable[str] = (),
) -> Lexicon:
    """Learns a lexicon from the texts of a bounded sample of the labelled ids; ``exceptions`` are added to those found."""
    spark = docs.sparkSession
    small_batches(spark)
    rows, classes = labelled_sample(docs, labels, key, text, toxic, sample)
    drawn = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    all1, all0 = drawn.get(1, 0), drawn.get(0, 0)
    if not all1 or not all0:
        discard(rows)
        return Lexicon({})
    counted = written(_counted(rows, _terms(F.col("folded"))).where("n1 >= 2"), "terms")
    odds, g = _excess(F.col("n1"), F.col("n0"), all1, all0)
    enough = 2 * math.log(max(1, counted.count()) / ERROR)
    best = counted.select("phrase", odds.alias("odds"), g.alias("g")).where((F.col("odds") > 0) & (F.col("g") >= enough))
    weights: dict[str, float] = {}
    taken: set[str] = set()  # beginnings of the chosen terms
    for r in best.orderBy(F.desc("g"), F.desc(F.length("phrase")), "phrase").limit(MAX_TERMS).collect():
        t = r["phrase"]
        if t not in taken and not any(t[:n] in weights for n in range(1, len(t))):
            weights[t] = r["odds"]
            taken |= {t[:n] for n in range(1, len(t) + 1)}
    discard(counted)
    found = Lexicon(weights)
    shields = {t for e in exceptions if (t := term(e)).strip()}
    for _ in range(ROUNDS if weights else 0):
        # the phrases that most clean texts have come first, so that what they explain is not counted for others
        found = Lexicon(weights, frozenset(shields))
        odds, _ = _excess(F.col("n1"), F.col("n0"), all1, all0)
        around = _counted(rows, _contexts(F.col("folded"), found)).where("n0 >= 3").select("phrase", "n0", odds.alias("odds")).where("odds <= 0")
        new = around.orderBy(F.desc("n0"), "phrase").limit(MAX_EXCEPTIONS - len(shields)).collect()
        if not new:
            break
        shields |= {r["phrase"] for r in new if 2 * r["n0"] >= new[0]["n0"]}
    found = Lexicon(weights, frozenset(shields))
    weighed = rows.select("y", evidence(F.col("folded"), found, folded=True).alias("e")).select("y", F.least(F.col("e.evidence"), F.lit(_MAX_EVIDENCE)).alias("evidence"))
    bins = weighed.groupBy(F.round(F.col("evidence") * _BINS_A_UNIT).alias("bin")).agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).orderBy("bin").collect()
    # a class of which only a share was drawn counts as the whole
    by = {c: classes[c] / max(1, min(classes[c], sample)) for c in (0, 1)}
    slope, intercept = fit((r["bin"] / _BINS_A_UNIT, r["n1"] * by[1], r["n0"] * by[0]) for r in bins)
    discard(rows)
    return Lexicon(found.weights, found.exceptions, slope, intercept)


def score(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1), ``predicted`` (1 from a score of 0.5 on), ``evidence`` and ``n_matches``; columns of these names are replaced."""
    names = ("score", "predicted", "evidence", "n_matches")
    found = free_name(df, "toxicity")
    kept = [c for c in df.columns if c.lower() not in names]
    seen = F.col(f"{found}.evidence")
    p = F.lit(0.0) if math.isinf(lexicon.intercept) else 1 / (1 + F.exp(-(F.least(seen, F.lit(_MAX_EVIDENCE)) * lexicon.slope + lexicon.intercept)))
    told = df.withColumn(found, evidence(F.col(text), lexicon)).select(*kept, p.alias("score"), seen.alias("evidence"), F.col(f"{found}.n_matches").alias("n_matches"))
    return told.select(*kept, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "n_matches")
