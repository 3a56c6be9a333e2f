"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram's vector binds (multiplies) its
letters' vectors, each permuted (rolled) by its distance from the n-gram's end. Bundling (adding) the vectors of all
n-grams gives a text's vector, and of all training texts of a language its prototype. The prediction is the language
whose prototype has the largest cosine with the text; the score is that cosine, negative ones as 0.

Texts are lower-cased; runs of code points that are not letters become one blank, which has a vector too, and a blank
stands before and after each text. All sums are of integers, so results depend on no order or partitioning.

Defined results: texts that are null or without letters get `und` and score 0; ties go to the language that sorts first;
training rows with null language are left out; if nothing can be learned, all texts get `und`; null ids count as the
empty string for the fold; extra columns are ignored; an empty table gives an empty table. Texts are read whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, classes
from .common import text_slices, trim

DIMENSIONS = 1024
ORDER = 3
SEED = 7
CHUNK_CHARS = 1 << 20
#: Prototypes are held by the driver and every task: DIMENSIONS * 8 bytes a language.
MAX_LANGUAGES = 4096
UNDETERMINED = "und"
CODE_BITS = 21


@functools.lru_cache(maxsize=1 << 15)
def letter(code: int) -> np.ndarray:
    bits = np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, DIMENSIONS, np.int8)
    return 2 * bits - 1


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts, as packed code points, and the text of each."""
    joined = "\n".join([x.lower() for x in texts]) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.fromiter((len(x.lower()) for x in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    letters = classes()[codes] == LETTER
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # one blank after each run of letters; a text's own also stands before the next text
    kept = np.concatenate([[0], np.where(letters, codes, 0)[keep]]).astype(np.uint64)
    owner = np.concatenate([[-1], owner[keep]])
    n = len(kept) - ORDER + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for i in range(ORDER):
        grams = (grams << np.uint64(CODE_BITS)) | kept[i : i + n]
    valid = owner[1 : 1 + n] == owner[ORDER - 1 : ORDER - 1 + n]
    return grams[valid], owner[1 : 1 + n][valid]


def distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique with return_inverse; without sorting where few letters occur."""
    mask = np.uint64((1 << CODE_BITS) - 1)
    places = [((grams >> np.uint64(CODE_BITS * i)) & mask).astype(np.int64) for i in range(ORDER)]
    seen = np.zeros(1 << CODE_BITS, bool)
    for codes in places:
        seen[codes] = True
    letters = np.flatnonzero(seen)
    if len(letters) ** ORDER > 1 << 22:
        return np.unique(grams, return_inverse=True)
    rank = np.zeros(1 << CODE_BITS, np.int64)
    rank[letters] = np.arange(len(letters))
    small = np.zeros(len(grams), np.int64)
    for codes in reversed(places):
        small = small * len(letters) + rank[codes]
    present = np.zeros(len(letters) ** ORDER, bool)
    present[small] = True
    found = np.flatnonzero(present)
    index = np.zeros(len(present), np.int64)
    index[found] = np.arange(len(found))
    unique = np.zeros(len(found), np.uint64)
    rest = found.copy()
    for i in range(ORDER):
        unique |= letters[rest % len(letters)].astype(np.uint64) << np.uint64(CODE_BITS * i)
        rest //= len(letters)
    return unique, index[small]


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    out = np.ones((len(grams), DIMENSIONS), np.int8)
    for place in range(ORDER):
        codes, inverse = np.unique((grams >> np.uint64(CODE_BITS * (ORDER - 1 - place))) & np.uint64((1 << CODE_BITS) - 1), return_inverse=True)
        out *= np.stack([np.roll(letter(int(c)), ORDER - 1 - place) for c in codes])[inverse]
    return out


def bundles(owners: np.ndarray, grams: np.ndarray, rows: int) -> np.ndarray:
    """Sums of n-gram vectors by owner, exact in double precision."""
    total = np.zeros((rows, DIMENSIONS))
    if not len(grams):
        return total
    unique, inverse = distinct(grams)
    width = 8192
    exact = np.float32 if len(grams) < 1 << 24 else np.float64
    for start in range(0, len(unique), width):
        part = unique[start : start + width]
        inside = slice(None) if len(part) == len(unique) else (inverse >= start) & (inverse < start + len(part))
        counts = np.bincount(owners[inside] * len(part) + inverse[inside] - start, minlength=rows * len(part)).reshape(rows, -1)
        total += counts.astype(exact) @ gram_vectors(part).astype(exact)
    return total


def held_out(key: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds == fold


def learn_profiles(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, int]]:
    """By language of the rows with one, the prototype and how many n-grams it adds up. Tasks add up their texts; only sums
    are shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in text_slices(batch, 1, CHUNK_CHARS):
                langs = part.column(0).to_pylist()
                names = sorted(set(langs))
                index = {x: i for i, x in enumerate(names)}
                grams, owner = ngrams(texts)
                of = np.array([index[x] for x in langs])
                sizes = np.bincount(of[owner], minlength=len(names))
                for name, row in zip(names, np.column_stack([bundles(of[owner], grams, len(names)), sizes]), strict=True):
                    sums[name] = sums.get(name, 0) + row
        if sums:
            values = [x.astype(np.int64) for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(values, pa.list_(pa.int64()))], ["lang", "vector"])

    partial = df.where(F.col(lang).isNotNull()).selectExpr(f"`{lang}` as lang", f"`{text}` as text").mapInArrow(run, "lang string, vector array<bigint>")
    sums = partial.select("lang", F.posexplode("vector").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    rows = sums.where("value <> 0").groupBy("lang").agg(F.collect_list(F.struct("at", "value")).alias("cells")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = {}
    for row in sorted(rows, key=lambda x: x.lang):
        sums = np.zeros(DIMENSIONS + 1)
        sums[[x.at for x in row.cells]] = [x.value for x in row.cells]
        found[row.lang] = sums[:DIMENSIONS], int(sums[DIMENSIONS])
    return found


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language."""
    return {name: vector for name, (vector, _) in learn_profiles(df, text, lang).items()}


def classify(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, lang_pred, score)."""
    names = list(prototypes)
    matrix = np.stack([v / np.linalg.norm(v) for v in prototypes.values()], axis=1) if names else np.zeros((DIMENSIONS, 0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, 1, CHUNK_CHARS):
                n = len(texts)
                grams, owner = ngrams(texts)
                vectors = bundles(owner, grams, n)
                size = np.linalg.norm(vectors, axis=1)
                size[size == 0] = 1
                cosines = (vectors @ matrix) / size[:, None]
                seen = np.bincount(owner, minlength=n) > 0
                if names:
                    best = cosines.argmax(axis=1)
                    pred = [names[i] if ok else UNDETERMINED for i, ok in zip(best.tolist(), seen.tolist(), strict=True)]
                    score = np.where(seen, np.clip(cosines.max(axis=1), 0, 1), 0.0)
                else:
                    pred, score = [UNDETERMINED] * n, np.zeros(n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred), pa.array(score)], ["key", "lang_pred", "score"])

    source = df.selectExpr(f"`{key}` as key", f"`{text}` as text")
    return source.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("key", key)


def language_predictions(df: DataFrame) -> DataFrame:
    """Learns on four folds of five and predicts every document."""
    fold = held_out(F.col("doc_id"))
    found = classify(df, learn(df.where(~fold)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def known_language(df: DataFrame, profiles: dict[str, tuple[np.ndarray, int]], share: float = 0.25, errors: float = 3.0) -> DataFrame:
    """The rows of df, all columns, without those of no letter, or like no learned language.

    An n-gram's likeness to a language is its projection on the prototype. Over a text of any length its mean estimates the
    language's own mean if the text is of that language, and 0 if it is of none; the error is the text's norm over
    sqrt(DIMENSIONS) and its n-grams, which counts repeated n-grams as what they are. A text goes if, for every language,
    its mean and `errors` standard errors are under `share` of the language's own mean: so a brief one needs clearer
    evidence. If nothing was learned, all texts with a letter stay."""
    names = df.columns
    vectors = {name: v / np.linalg.norm(v) for name, (v, _) in profiles.items()}
    own = np.array([np.linalg.norm(v) / n for v, n in profiles.values()])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            for part, texts in text_slices(batch, at, CHUNK_CHARS):
                grams, owner = ngrams(texts)
                size = np.bincount(owner, minlength=len(texts))
                keep = size > 0
                if vectors:
                    sums = bundles(owner, grams, len(texts))
                    highest = sums @ np.stack(list(vectors.values()), axis=1) + errors * np.linalg.norm(sums, axis=1)[:, None] / np.sqrt(DIMENSIONS)
                    keep &= (highest >= share * size[:, None] * own).any(axis=1)
                yield part.filter(pa.array(keep))
        trim()

    return df.mapInArrow(run, df.schema)
