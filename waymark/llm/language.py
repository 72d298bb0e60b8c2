"""Language identification by compression.

Each language is a raw-content zstandard dictionary made of a bounded
sample of its labelled texts. A text is encoded once per language and
belongs to the one whose dictionary makes it smallest; a narrow margin to
the runner-up is a rejection.

Texts are lower-cased and every run of characters that are not letters
becomes one space. The whole text is encoded, in segments of ``SEGMENT``
bytes whose sizes add up, so that a long text cannot replace the
dictionary by its own past. Short texts are repeated up to ``SHORT``
bytes, since the encoder stores tiny blocks raw.

Null texts, and texts without a letter, are ``und`` with score 0 and
count as rejected. Ties go to the language with more labelled rows, then
to the lower code point. With one language every text with a letter gets
it at score 1; with none every text is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import free_name, small_batches

UNKNOWN = "und"
SEGMENT, SHORT = 1024, 192
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> bytes:
    """The text's letters in lower case between single spaces; empty if it has none."""
    kept = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, kept)):
        return b""
    return f" {kept} ".encode()


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, in order of preference on ties."""

    dictionaries: tuple[tuple[str, bytes], ...]
    min_margin: float = 0.01


class Classifier:
    """The encoders of one worker."""

    def __init__(self, model: LanguageModel):
        import zstandard as zstd

        params = zstd.ZstdCompressionParameters(
            strategy=zstd.STRATEGY_GREEDY, min_match=4, search_log=3, window_log=17, hash_log=15, chain_log=15, target_length=16,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        self.encoders = []
        for lang, content in model.dictionaries:
            held = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            self.encoders.append((lang, zstd.ZstdCompressor(compression_params=params, dict_data=held)))

    def classify(self, text: str | None) -> tuple[str, float]:
        """(language, margin): by what share the best encoding is smaller than the next."""
        data = letters_only(text) if text else b""
        if not data or not self.encoders:
            return UNKNOWN, 0.0
        if len(data) < SHORT:
            data *= -(-SHORT // len(data))
        parts = [data[i : i + SEGMENT] for i in range(0, len(data), SEGMENT)]
        sizes = [sum(len(encoder.compress(p)) for p in parts) for _, encoder in self.encoders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = sizes[:best] + sizes[best + 1 :]
        margin = 1.0 - sizes[best] / min(others) if others else 1.0
        return self.encoders[best][0], margin


def train(
    labelled: DataFrame, text: str = "text", lang: str = "lang",
    dictionary_bytes: int = 32768, sample_docs: int = 128, max_languages: int = 256, min_margin: float = 0.01,
) -> LanguageModel:
    """Fits on a bounded sample of the labelled rows.

    The label counts cover all rows; of more than ``max_languages`` labels those with most rows are learnt. Of each label
    about ``2 * sample_docs`` different texts with the lowest hashes are taken, whole, one after another until the
    dictionary is full. The hash is the text's own, so the sample depends neither on ids nor on the order of rows, and
    repeated texts count once. Dictionaries are made where the sample lies; only they reach the driver. Rows without a
    label or text are passed over.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    per = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("hash").alias("texts"))
    known = per.orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    # hashes are uniform over 64 bits, so this threshold passes about 2 * sample_docs texts of a language
    span, low = float(2**64 - 2048), -(2**63)
    passes = F.lit(False)
    for r in known:
        passes |= (F.col("lang") == F.lit(r["lang"])) & (F.col("hash") <= F.lit(low + int(span * min(1.0, 2 * sample_docs / max(1, r["texts"])))))
    picked = rows.where(passes).groupBy("lang", "hash").agg(F.min("text").alias("text"))

    def learnt(sample: pd.DataFrame) -> pd.DataFrame:
        content = b""
        for t in sample.sort_values("hash")["text"]:
            content += letters_only(t)
            if len(content) >= dictionary_bytes:
                break
        return pd.DataFrame({"lang": [sample["lang"].iloc[0]], "content": [content[:dictionary_bytes]]})

    contents = {r["lang"]: bytes(r["content"]) for r in picked.groupBy("lang").applyInPandas(learnt, "lang string, content binary").collect()}
    ranked = sorted(known, key=lambda r: (-r["n"], r["lang"]))
    return LanguageModel(tuple((r["lang"], contents[r["lang"]].rjust(8)) for r in ranked if contents.get(r["lang"])), min_margin)


def language_of(model: LanguageModel, text: Column) -> Column:
    """A struct (lang, margin) of each whole text."""

    small_batches()

    @F.pandas_udf("lang string, margin double")
    def classified(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(model)
        for texts in batches:
            yield pd.DataFrame([classifier.classify(t) for t in texts], columns=["lang", "margin"])

    return classified(text)


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (the margin, 0 to 1) and ``rejected`` (no letter, or a margin under the model's).

    Columns of these names are replaced, others of ``df`` stay, whatever they are called.
    """
    names = ("lang_pred", "score", "rejected")
    found = free_name(df, "language")
    kept = [c for c in df.columns if c.lower() not in names]
    told = df.withColumn(found, language_of(model, F.col(text)))
    lang, margin = F.col(f"{found}.lang"), F.col(f"{found}.margin")
    rejected = (lang == UNKNOWN) | (margin < F.lit(model.min_margin))
    return told.select(*kept, lang.alias("lang_pred"), margin.alias("score"), rejected.alias("rejected"))
