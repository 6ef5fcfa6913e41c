"""Quality rules: word statistics of a text and the fertility of public tokenisers.

Fertility is measured word by word: characters per token, share of tokens that stand for
single bytes, and entropy of the text's tokens.  Bands around the median of a language, as wide as
a multiple of its median deviation, say what is usual; a text outside a band is rejected.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.stages import staged
from dossier.llm.words import KEEP, Interner, Ragged, numbered_words, slices

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FERTILITY = "n_pieces long, byte_pieces long, piece_entropy double"
SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "


class Fertility:
    """Pieces of words by a sentencepiece model with byte fallback."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(size)])
        self.forget()

    def forget(self) -> None:
        """Free what the distinct words of a task took; workers live on between tasks."""
        self.words, self.pieces = Interner(), Ragged(np.int32)

    def number(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > KEEP:
            self.forget()
        numbers, starts = numbered_words(part, self.words)
        new = self.words.take_new()
        if new:
            ids = self.model.encode(new, num_threads=1)
            flat = np.fromiter((i for row in ids for i in row), np.int32)
            self.pieces.append(flat, np.fromiter(map(len, ids), np.int64, len(ids)))
        return numbers, starts

    def measure(self, numbers: np.ndarray) -> tuple[int, int, float]:
        ids = np.sort(self.pieces.gather(numbers))
        if not len(ids):
            return 0, 0, 0.0
        ends = np.flatnonzero(np.append(ids[1:] != ids[:-1], True))
        share = np.diff(ends, prepend=-1) / len(ids)
        return len(ids), int(self.is_byte[ids].sum()), float(-(share * np.log2(share)).sum())


@lru_cache(maxsize=2)
def fertility(path: str) -> Fertility:
    return Fertility(path)


def repeated_words(numbers: np.ndarray) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    if len(numbers) < 4:
        return 0
    # Exact for fewer than 2**21 distinct words, which KEEP and one text's length ensure
    # in all but freak texts; those are numbered anew.
    if numbers.max() >= 1 << 21:
        numbers = np.unique(numbers, return_inverse=True)[1]
    if numbers.max() < 1 << 21:
        keys = (numbers[:-2] << 42) | (numbers[1:-1] << 21) | numbers[2:]
    else:
        windows = np.stack([numbers[:-2], numbers[1:-1], numbers[2:]], 1)
        keys = np.unique(windows, axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order] = np.append(same, False) | np.append(False, same)
    covered = np.zeros(len(numbers), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def base_statistics(text: str, numbers: np.ndarray) -> tuple[int, int, int, int, int]:
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(numbers),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(numbers),
    )


@lru_cache(maxsize=1)
def letter_scripts() -> tuple[np.ndarray, list[str]]:
    """The number of each code point's script, 0 for all but letters, and the scripts' names.

    A letter's script is the first word of its Unicode name, that of its plain form if it has one.
    """
    numbers, table = {"none": 0}, np.zeros(sys.maxunicode + 1, np.uint8)
    for code in range(len(table)):
        if unicodedata.category(chr(code))[0] == "L":
            script = unicodedata.name(unicodedata.normalize("NFKC", chr(code))[0], "none").split()[0].lower()
            script = {"cjk": "han", "hiragana": "kana", "katakana": "kana"}.get(script, script)
            table[code] = numbers.setdefault(script, len(numbers))
    return table, list(numbers)


def script_of(text: str) -> str:
    """The script of most letters of the whole text, "none" without letters.  Han and kana count
    together, as Japanese mixes them: "kana" if a tenth of both is kana, else "han"."""
    table, names = letter_scripts()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(table[codes], minlength=len(names))
    counts[0] = 0
    han, kana = names.index("han"), names.index("kana")
    both, of_kana = counts[han] + counts[kana], counts[kana]
    counts[han], counts[kana] = (0, both) if 10 * of_kana >= both else (both, 0)
    return names[int(counts.argmax())]


def measured(docs: DataFrame, model_path: str, text_col: str, keep: list[str], name: str = "_measured") -> DataFrame:
    """The ``keep`` columns of ``docs``, ``_script``, and a struct of word statistics and fertility of the whole text."""
    at = docs.columns.index(text_col)
    kept = [docs.columns.index(column) for column in keep]
    kinds = [pa.int64()] * 7 + [pa.float64()]
    names = [part.split()[0] for part in f"{BASE}, {FERTILITY}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = fertility(model_path)
        for batch in batches:
            rows, scripts = [], []
            for part in slices([text or "" for text in batch.column(at).to_pylist()]):
                numbers, starts = tool.number(part)
                scripts += map(script_of, part)
                for text, start, end in zip(part, starts.tolist(), starts[1:].tolist()):
                    own = numbers[start:end]
                    rows.append((*base_statistics(text, own), *tool.measure(own)))
            values = zip(*rows) if rows else [[]] * len(kinds)
            struct = pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(scripts, pa.string()), struct], [*keep, "_script", name])
        tool.forget()

    inner = T.StructType([T.StructField(n, T.DoubleType() if pa.types.is_float64(k) else T.LongType()) for n, k in zip(names, kinds)])
    schema = T.StructType([*(docs.schema[column] for column in keep), T.StructField("_script", T.StringType()), T.StructField(name, inner)])
    return docs.mapInArrow(run, schema)


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def _judged(
    docs: DataFrame,
    model_path: str,
    width: float = 8.0,
    least_docs: int = 30,
    text_col: str = "text",
    lang_col: str | None = "lang",
    max_byte_share: float = 0.2,
    keep: list[str] | None = None,
) -> DataFrame:
    m = "_measured"
    keep = docs.columns if keep is None else keep
    lang = F.lower(F.col(lang_col)) if lang_col else F.lit(None).cast("string")
    rows = measured(docs.select("*", lang.alias("_lang")), model_path, text_col, [*keep, "_lang"], m)
    table = staged(rows.withColumn("_base_failed", base_failed(m)), "quality")
    entropy = F.col(f"{m}.piece_entropy") / F.log2(F.col(f"{m}.n_pieces") + 1)
    ratio = F.col(f"{m}.word_chars") / F.col(f"{m}.n_pieces")
    bytes_ = F.col(f"{m}.byte_pieces") / F.col(f"{m}.n_pieces")
    passed = table.where(~F.col("_base_failed")).select(
        "_lang", "_script", f"{m}.n_pieces", ratio.alias("r"), entropy.alias("e"), bytes_.alias("b")
    )

    def bands(key: str) -> DataFrame:
        # Stored, so that its true size decides how the rows of a frequent language meet it.
        middle = staged(
            passed.where(F.col(key).isNotNull()).groupBy(key).agg(
                *(F.percentile_approx(c, 0.5, 10_000).alias(f"{c}0") for c in "reb"), F.count("*").alias("n")
            ),
            f"medians{key}",
        )
        off = (
            passed.join(middle, key)
            .groupBy(key)
            .agg(
                F.percentile_approx(F.abs(F.col("r") - F.col("r0")) * F.sqrt("n_pieces"), 0.5, 10_000).alias("rd"),
                F.percentile_approx(F.abs(F.col("e") - F.col("e0")), 0.5, 10_000).alias("ed"),
                F.percentile_approx(F.abs(F.col("b") - F.col("b0")), 0.5, 10_000).alias("bd"),
            )
        )
        floor = lambda d, v: F.greatest(F.col(d), 0.02 * F.col(v))
        band = F.struct("r0", floor("rd", "r0").alias("rd"), "e0", floor("ed", "e0").alias("ed"), "b0", "bd")
        return middle.join(off, key).select(key, "n", band.alias(f"{key}_band"))

    langs = staged(bands("_lang").where(F.col("n") >= least_docs).drop("n"), "bands-lang")
    scripts = staged(bands("_script").drop("n"), "bands-script")
    judged = table.join(langs, "_lang", "left").join(scripts, "_script", "left")
    band = F.coalesce("_lang_band", "_script_band")
    usual = (
        (F.abs(ratio - band["r0"]) * F.sqrt(f"{m}.n_pieces") <= width * band["rd"])
        & (F.abs(entropy - band["e0"]) <= width * band["ed"])
        & (F.abs(bytes_ - band["b0"]) <= F.greatest(width * band["bd"], F.lit(max_byte_share)))
    )
    kept = ~F.col("_base_failed") & F.coalesce(usual, F.lit(True))
    return judged.select(*keep, m, "_base_failed", kept.alias("_kept"))


def _plain(docs: DataFrame, settings: dict) -> tuple[DataFrame, dict]:
    """``docs`` with columns named by their place, so that no name clashes with ours."""
    place = {name: f"_c{i}" for i, name in enumerate(docs.columns)}
    settings = {"text_col": "text", "lang_col": "lang"} | settings
    for key in ("text_col", "lang_col"):
        settings[key] = place[settings[key]] if settings[key] else None
    return docs.toDF(*place.values()), settings


def quality_rules(docs: DataFrame, model_path: str, id_col: str = "doc_id", **settings) -> DataFrame:
    """``doc_id``, the base statistics, the fertility, ``base_failed`` and ``kept`` of every row.

    A text that passes the base rules is judged by three bands of its language (of its script
    where the language is null or has fewer than ``least_docs`` such texts): characters per
    token, entropy and the share of tokens that stand for single bytes must lie within ``width``
    median deviations of the median, over all texts that pass the base rules; the byte share may
    differ from it by ``max_byte_share`` in any case, so in a language free of such tokens that is the most.  Characters per token scatter less in longer texts, so their
    deviation counts times the root of the number of tokens; entropy grows with the length, so it is
    compared with the logarithm of the number of tokens.  A group whose texts are all alike has bands
    with a floor of 2 % of the median.  A null text counts as empty and fails the base
    rules.  Rows are independent: repeated rows and null ids stay as they are.  An empty table gives an
    empty one.  ``settings`` are ``width``, ``least_docs``, ``max_byte_share``, ``text_col`` and ``lang_col`` (None: scripts
    only).
    """
    plain, settings = _plain(docs, settings)
    own_id = f"_c{docs.columns.index(id_col)}"
    judged = _judged(plain, model_path, keep=[own_id], **settings)
    return judged.select(
        F.col(own_id).cast("long").alias("doc_id"),
        "_measured.*",
        F.col("_base_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
    )


def good_documents(docs: DataFrame, model_path: str, **settings) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with their own columns."""
    plain, settings = _plain(docs, settings)
    return _judged(plain, model_path, **settings).where("_kept").select(*plain.columns).toDF(*docs.columns)
