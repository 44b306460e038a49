"""Language ID with language-bitmask n-gram filters.

One Bloom filter holds the n-grams of all languages, sliced by bits: every slot
is a mask with a bit for each language, and the mask of an n-gram is the AND of
its slots, so one look-up tells all languages that contain it. A text's count
for a language is the number of its n-grams whose mask has the language's bit,
corrected for the false positives that the fill of that language's slice makes.
The language with the largest share of n-grams wins, ties going to the first by
name; the score is its part of all corrected shares.

An n-gram is a run of ``GRAM`` UTF-8 bytes of the lower-cased text in which every
run of white space, digits and ASCII signs is one byte; n-grams with such a byte
inside are left out, at their ends it marks where a word begins or ends. Counting
runs over the n-grams that begin in ``BLOCK`` codes at a time, however long a text is;
blocks overlap, so a text's counts are those of the whole text.

The fit takes at most ``SAMPLE`` texts of each language (least hash of the key) and
an n-gram if it is in at least ``SHARE`` of them and in two.

Edge cases: null texts and texts without a letter are ``und`` with score 0; so are
all texts if nothing was learned. A text with no known n-gram gets the first
language with score 0. Null languages teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliolens.llm.common import column, small_batches, stored

GRAM, SAMPLE, SHARE = 4, 3000, 0.02
HASHES, SLOTS_PER_GRAM = 3, 8
BLOCK = 1 << 20
UNKNOWN = "und"
_APART = 32


def _letters() -> np.ndarray:
    """Byte to byte: letters and parts of non-ASCII characters stay, the rest separates."""
    keep = [b for b in range(256) if b >= 128 or chr(b).isalpha()]
    found = np.full(256, _APART, np.uint8)
    found[keep] = keep
    return found


_LETTERS = _letters()


def _codes(data: bytes) -> np.ndarray:
    """The bytes of a lower-cased UTF-8 text with one separator for each run, one at both ends."""
    codes = _LETTERS[np.frombuffer(data, np.uint8)]
    codes = np.concatenate(([np.uint8(_APART)], codes, [np.uint8(_APART)]))
    apart = codes == _APART
    return codes[~(apart & np.concatenate(([False], apart[:-1])))]


def _packed(codes: np.ndarray) -> np.ndarray:
    """The n-grams within these codes as packed numbers."""
    if len(codes) < GRAM:
        return np.zeros(0, np.uint32)
    codes, n = codes.astype(np.uint32), len(codes) - GRAM + 1
    packed, inside = np.zeros(n, np.uint32), np.zeros(n, bool)
    for j in range(GRAM):
        part = codes[j : j + n]
        packed = packed << np.uint32(8) | part
        if 0 < j < GRAM - 1:
            inside |= part == _APART
    return packed[~inside]


def grams(data: bytes) -> np.ndarray:
    """The n-grams of a lower-cased UTF-8 text as packed numbers, repeats included."""
    return _packed(_codes(data))


@dataclass
class LanguageFilter:
    languages: list[str] = field(default_factory=list)
    slots: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.uint64))  # words of the mask, slots
    shift: int = 63
    false: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def build(cls, found: dict[str, np.ndarray]) -> LanguageFilter:
        """Of the n-grams of each language."""
        languages = sorted(found)
        size = max([2, *(len(g) for g in found.values())]) * SLOTS_PER_GRAM
        bits = (size - 1).bit_length()
        slots = np.zeros(((len(languages) + 63) // 64 or 1, 1 << bits), np.uint64)
        made = cls(languages, slots, 64 - bits)
        for i, name in enumerate(languages):
            for at in made._places(np.asarray(found[name], np.uint32)):
                slots[i // 64, at] |= np.uint64(1 << i % 64)
        fill = [np.count_nonzero(slots[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / (1 << bits) for i in range(len(languages))]
        made.false = np.array(fill) ** HASHES
        return made

    def _places(self, packed: np.ndarray):
        key = packed.astype(np.uint64)
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[:HASHES]:
            h = (key + np.uint64(factor >> 7)) * np.uint64(factor)
            h ^= h >> np.uint64(29)
            yield (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(self.shift)

    def masks(self, packed: np.ndarray) -> np.ndarray:
        """Words of the mask, n-grams: all languages that contain each."""
        found = None
        for at in self._places(packed):
            here = self.slots[:, at]
            found = here if found is None else found & here
        return found

    def counts(self, data: bytes) -> tuple[int, np.ndarray]:
        """Number of n-grams, and of those that each language contains."""
        total, hits = 0, np.zeros(len(self.languages), np.int64)
        codes = _codes(data)
        for begin in range(0, len(codes), BLOCK):
            packed = _packed(codes[begin : begin + BLOCK + GRAM - 1])  # those that begin in the block
            total += len(packed)
            masks = self.masks(packed)
            for i in range(len(self.languages)):
                hits[i] += np.count_nonzero(masks[i // 64] & np.uint64(1 << i % 64))
        return total, hits

    def predict(self, data: bytes | None) -> tuple[str, float]:
        if data is None or not self.languages:
            return UNKNOWN, 0.0
        total, hits = self.counts(data)
        true = np.maximum(0.0, (hits - total * self.false) / (1 - np.minimum(self.false, 0.999)))
        if not total or not true.sum():
            return self.languages[0], 0.0
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / true.sum())


def _lowered(text: str) -> Column:
    return F.encode(F.lower(column(text).cast("string")), "UTF-8")


def fit_languages(docs: DataFrame, text="text", lang="lang", key="doc_id", sample: int = SAMPLE, share: float = SHARE) -> LanguageFilter:
    """The filter of at most ``sample`` texts of each language; the caller chooses which rows may teach."""
    known = docs.filter(column(lang).isNotNull() & column(text).isNotNull())
    keys = known.select(column(key).alias("k"), column(lang).cast("string").alias("l"))
    # Rows far above the wanted hashes go before anything is sorted, however many a language has.
    sizes = keys.groupBy("l").agg(F.count("*").alias("n")).select("l", (F.lit(2.0) * sample / F.col("n")).alias("part"))
    keys = keys.join(sizes, "l").filter(F.xxhash64("k") / F.lit(2.0**64) + 0.5 <= F.col("part") + 0.001)
    nth = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("k"), "k"))
    chosen = keys.withColumn("nth", nth).filter(F.col("nth") <= sample).select("k", "l").distinct()
    texts = known.select(column(key).alias("k"), column(lang).cast("string").alias("l"), _lowered(text).alias("x"))

    @F.pandas_udf("array<long>")
    def own(data: pd.Series) -> pd.Series:
        return data.map(lambda x: np.unique(grams(x)).astype(np.int64))

    taught = stored(small_batches(texts).join(chosen, ["k", "l"]).select("l", own("x").alias("g")))
    sizes = {r["l"]: r["n"] for r in taught.groupBy("l").agg(F.count("*").alias("n")).collect()}
    least = F.create_map(*[F.lit(v) for l, n in sizes.items() for v in (l, float(max(2, share * n)))]) if sizes else None
    if least is None:
        return LanguageFilter()
    often = taught.select("l", F.explode("g").alias("g")).groupBy("l", "g").agg(F.count("*").alias("n"))
    # Few texts have each rare n-gram: at most (n-grams of a text) / share are kept for a language.
    kept = often.filter(F.col("n") >= least[F.col("l")]).groupBy("l").agg(F.collect_list("g").alias("g")).collect()
    return LanguageFilter.build({r["l"]: np.array(r["g"], np.int64).astype(np.uint32) for r in kept} | {l: np.zeros(0, np.uint32) for l in sizes.keys() - {r["l"] for r in kept}})


def language_column(model: LanguageFilter, text: str = "text") -> Column:
    """Struct of ``lang_pred`` and ``score``."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(x) for x in data], columns=["lang_pred", "score"])

    body = column(text).cast("string")
    return predict(F.when(body.rlike(r"\p{L}"), _lowered(text)))


def languages(docs: DataFrame, model: LanguageFilter, key="doc_id", text="text") -> DataFrame:
    """One row per document: the key, ``lang_pred`` and ``score``."""
    found = small_batches(docs).select(column(key).alias(key), language_column(model, text).alias("found"))
    return found.select(column(key), "found.lang_pred", "found.score")
