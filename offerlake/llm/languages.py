"""Language identification: script ranges, byte-trigram word scores, Viterbi spans with a switching penalty."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vec import LOWER, NOT_LETTER, Words, groups, text_buffer

BITS = 16
SWITCH = 12.0
MIN_SHARE = 0.005
GROUP_BYTES = 2 << 20
# First and last code point of the script ranges.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "oriya": [(0xB00, 0xB7F)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "burmese": [(0x1000, 0x107F)],
    "georgian": [(0x10A0, 0x10FF)],
    "ethiopic": [(0x1200, 0x137F)],
    "khmer": [(0x1780, 0x17FF)],
    "mongolian": [(0x1800, 0x18AF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
NAMES = ["other", *SCRIPTS]
_PREDICTED = "doc_id bigint, lang_pred string, score double, spans array<struct<lang:string,first:bigint,last:bigint>>"
_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))


def script_table() -> np.ndarray:
    """Script number by the first two bytes of a character in UTF-8: 64 code points share them at least."""
    out = np.zeros(1 << 16, dtype=np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            for cp in range(low, high + 1, 1 if low < 0x80 else 32):
                b = chr(cp).encode()
                if len(b) == 1:
                    out[b[0] << 8 : (b[0] + 1) << 8] = k
                elif len(b) == 2:
                    for x in range(cp, min(cp + 32, high + 1)):
                        y = chr(x).encode()
                        out[y[0] << 8 | y[1]] = k
                else:
                    out[b[0] << 8 | b[1]] = k
    return out


SCRIPT_OF = script_table()


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A bucket for each byte from it and its neighbours; bytes outside words, and text bounds, count as blanks."""
    low = np.where(NOT_LETTER[raw], np.uint8(0x20), LOWER[raw]).astype(np.uint32)
    left, right = np.full(len(low), 0x20, np.uint32), np.full(len(low), 0x20, np.uint32)
    left[1:], right[:-1] = low[:-1], low[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(low))]
    left[inner] = 0x20
    right[inner - 1] = 0x20
    code = (left << np.uint32(16)) | (low << np.uint32(8)) | right
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


def word_scripts(words: Words) -> np.ndarray:
    first = words.raw[words.start].astype(np.int64) << 8
    second = words.raw[np.minimum(words.start + 1, len(words.raw) - 1)]
    return SCRIPT_OF[first | second].astype(np.int64)


def _statistics(langs: list[str]):
    """Trigram and script counts by language, summed in the task. Keys past the buckets are scripts."""
    number = {x: i for i, x in enumerate(langs)}
    wide = (1 << BITS) + len(NAMES)

    def run(batches):
        total = np.zeros(len(langs) * wide, dtype=np.int64)
        for batch in groups(batches, "text", GROUP_BYTES):
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            raw, offsets = text_buffer(batch.column(1))
            if not len(raw):
                continue
            words = Words(raw, offsets, NOT_LETTER)
            solid = ~NOT_LETTER[raw]
            of_byte = np.repeat(lang, np.diff(offsets))
            total += np.bincount((of_byte * wide + trigrams(raw, offsets))[solid], minlength=len(total))
            if len(words.start):
                total += np.bincount(lang[words.text_of_word()] * wide + (1 << BITS) + word_scripts(words), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // wide).astype(np.int32)), pa.array((at % wide).astype(np.int32)), pa.array(total[at])], names=["lang", "k", "n"])

    return run


@dataclass
class LanguageModel:
    langs: list[str]
    logp: np.ndarray  # buckets x languages
    allowed: np.ndarray  # scripts x languages: 0, or a large penalty where a script is foreign to a language

    @classmethod
    def build(cls, langs: list[str], rows: list) -> LanguageModel:
        n = np.zeros((len(langs), (1 << BITS) + len(NAMES)))
        for r in rows:
            n[r["lang"], r["k"]] = r["n"]
        grams, scripts = n[:, : 1 << BITS] + 0.5, n[:, 1 << BITS :]
        logp = np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32)
        fits = scripts >= MIN_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
        fits |= ~fits.any(0)
        return cls(langs, np.ascontiguousarray(logp), np.where(fits, 0.0, -1e4).T.astype(np.float32))


def word_scores(model: LanguageModel, words: Words) -> np.ndarray:
    """Log-likelihood of each word in each language, foreign scripts ruled out."""
    if not len(words.start):
        return np.zeros((0, len(model.langs)), np.float32)
    bucket = trigrams(words.raw, words.offsets)
    solid = ~NOT_LETTER[words.raw]
    where = np.cumsum(solid) - solid
    out = np.add.reduceat(model.logp[bucket[solid]], where[words.start], axis=0)
    return out + model.allowed[word_scripts(words)]


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word of each text; a change of language costs ``penalty``.

    Runs word by word over all texts of the group at once, the longest first, so that those still running
    are a prefix.
    """
    count = np.diff(first)
    path = np.zeros(len(score), dtype=np.int64)
    order = np.argsort(-count, kind="stable")
    starts = first[:-1][order]
    live = np.searchsorted(-count[order], -np.arange(count.max() if len(count) else 0), side="left")  # texts longer than t
    came = np.zeros(score.shape, dtype=np.int16)
    here = np.arange(score.shape[1])
    best = np.zeros((len(order), score.shape[1]), dtype=np.float64)
    for t, n in enumerate(live.tolist()):
        at = starts[:n] + t
        if t == 0:
            best[:n] = score[at]
            continue
        b = best[:n]
        top = b.argmax(1)
        jump = b[np.arange(n), top] - penalty
        stay = b >= jump[:, None]
        came[at] = np.where(stay, here, top[:, None])
        best[:n] = np.where(stay, b, jump[:, None]) + score[at]
    state = np.zeros(len(order), dtype=np.int64)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = starts[:n] + t
        more = live[t + 1] if t + 1 < len(live) else 0
        state[:more] = came[at[:more] + 1, state[:more]] if more else state[:0]
        state[more:n] = best[more:n].argmax(1)
        path[at] = state[:n]
    return path


def _predict(model, penalty: float):
    def run(batches):
        m: LanguageModel = model.value
        for batch in groups(batches, "text", GROUP_BYTES):
            raw, offsets = text_buffer(batch.column(1))
            words = Words(raw, offsets, NOT_LETTER)
            path = viterbi(word_scores(m, words), words.first, penalty)
            text = words.text_of_word()
            share = np.zeros((batch.num_rows, len(m.langs)))
            np.add.at(share, (text, path), words.end - words.start)
            pred, total = share.argmax(1), share.sum(1)
            turn = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (text[1:] != text[:-1]))) if len(path) else np.zeros(0, np.int64)
            ends = np.append(turn[1:], len(path)) - 1
            cuts = np.searchsorted(text[turn], np.arange(batch.num_rows + 1))
            local, name = words.first[:-1], np.array(m.langs, dtype=object)
            langs, scores, spans = [], [], []
            plain = np.add.reduceat(np.append((raw < 0x80) & ~NOT_LETTER[raw], False), np.minimum(offsets[:-1], len(raw))) * (np.diff(offsets) > 0)
            for i in range(batch.num_rows):
                # bytes of other code points pass for letters above: here they must be
                if not total[i] or (not plain[i] and not any(map(str.isalpha, batch.column(1)[i].as_py()))):
                    langs.append("und"), scores.append(0.0), spans.append([])
                    continue
                langs.append(name[pred[i]])
                scores.append(float(share[i, pred[i]] / total[i]))
                spans.append([{"lang": name[path[a]], "first": int(a - local[i]), "last": int(b - local[i])} for a, b in zip(turn[cuts[i] : cuts[i + 1]], ends[cuts[i] : cuts[i + 1]], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, _SPANS)], names=["doc_id", "lang_pred", "score", "spans"])

    return run


def identify_languages(docs: DataFrame, penalty: float = SWITCH) -> DataFrame:
    """The language of each whole text of ``docs`` (doc_id, text, lang), and its spans of one language each.

    Byte trigrams of words and scripts are counted over all documents with a language whose crc32 of the id is
    not 2 modulo 4. A word's scores are its log-likelihoods in the languages that use its script; Viterbi
    labels the words of a text, paying ``penalty`` for every change. The prediction is the language with most
    letters, the score its share of them.

    Returns doc_id, held_out, lang_pred, score, spans (lang, first and last word). Words are runs of letters.
    A null text, one without letters, and any text where no language was learnt: ``und``, 0, no spans.
    Repeated rows each get their row; a null doc_id is never held out nor learnt from.
    """
    spark = docs.sparkSession
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = rows.filter((rest != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    held = rows.select("doc_id", "text").withColumn("held", rest == 2)
    if not langs:
        return held.select("doc_id", F.col("held").alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.expr("cast(array() as array<struct<lang:string,first:bigint,last:bigint>>)").alias("spans"))
    counts = known.select("lang", "text").mapInArrow(_statistics(langs), "lang int, k int, n bigint").groupBy("lang", "k").agg(F.sum("n").alias("n"))
    # at most (2 ** 16 + scripts) rows a language, whatever the corpus
    model = spark.sparkContext.broadcast(LanguageModel.build(langs, counts.collect()))
    found = rows.select("doc_id", "text").mapInArrow(_predict(model, penalty), _PREDICTED)
    return found.select("doc_id", (rest == 2).alias("held_out"), "lang_pred", "score", "spans")
