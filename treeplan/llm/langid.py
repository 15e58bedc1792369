"""Language identification with spans of mixed text.

Each word (a run of letters and marks) gets a score for each language: the log likelihoods
of its character trigrams, word ends included, minus the best language's, not below
-CLIP. The script of its first letter narrows the candidates: a language that was learned
without that script gets -CLIP at once. Viterbi over the words, with a penalty for each
change of language, labels spans; the document gets the language of most letters.

The path over a document is exact. Most documents need no dynamic program: if no stretch
of words prefers another language by more than half the penalty, staying with the best
total is optimal (k stretches gain at most k/2 penalties and cost at least k - 1 changes,
or k with a return).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeplan.llm.shared import attach, exactly, slices

BITS = 16
CLIP = 4.0
SWITCH = 12.0
#: Labelled rows that a model is fitted on, of each language, about.
SAMPLE = 3000
#: Numbers that a model has at most (4 bytes each, and it is broadcast): up to 128 languages have 2^BITS trigram buckets
#: each, beyond that buckets are halved until all languages fit.
CELLS = 128 << BITS
#: A language has a script if this share of its letters is of it.
SHARE = 0.01
TOP = 0x32400
#: First code points of script ranges; a code point belongs to the last range at or before it.
SCRIPTS = (
    (0x0000, "other"), (0x0041, "latin"), (0x005B, "other"), (0x0061, "latin"), (0x007B, "other"), (0x00AA, "latin"), (0x00AB, "other"), (0x00BA, "latin"), (0x00BB, "other"), (0x00C0, "latin"),
    (0x02B9, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x2E80, "han"),
    (0x3000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"),
    (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFE70, "arabic"), (0xFEFF, "other"), (0xFF21, "latin"), (0xFF3B, "other"), (0xFF41, "latin"), (0xFF5B, "other"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
)
NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its lower case (0 if it is in no word), whether it is a letter, its script."""
    lower, letter = np.zeros(TOP, np.uint32), np.zeros(TOP, bool)
    for c in range(TOP):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            lower[c], letter[c] = (ord(low) if len(low) == 1 else c), kind == "L"
    first = np.array([a for a, _ in SCRIPTS])
    script = np.array([NAMES.index(name) for _, name in SCRIPTS], np.uint8)[np.searchsorted(first, np.arange(TOP), side="right") - 1]
    return lower, letter, script


@dataclass
class Words:
    """The words of some texts: trigram bucket of each character, where words begin and end, scripts, texts."""

    bucket: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    cut: np.ndarray  # words of text i: cut[i] : cut[i + 1]
    place: np.ndarray  # first code point of each word in its text


def words_of(texts: list[str | None]) -> Words:
    lower, letter, script = _tables()
    joined = "\n".join(t or "" for t in texts)
    codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4"), TOP - 1)
    low = lower[codes]
    inside = low > 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.flatnonzero(inside)
    wide = np.concatenate([[0], low, [0]]).astype(np.uint64)
    h = wide[at] * np.uint64(0x9E3779B97F4A7C15) + wide[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + wide[at + 2] * np.uint64(0x165667B19E3779F9)
    bucket = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32)
    length = end - begin
    first = np.concatenate([[0], np.cumsum(length)])[:-1]
    letters = np.add.reduceat(letter[codes[at]].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])])
    cut = np.searchsorted(begin, starts)
    place = begin - np.repeat(starts[:-1], np.diff(cut)) if len(begin) else begin
    return Words(bucket, first, length, letters, script[codes[begin]] if len(begin) else np.zeros(0, np.uint8), cut, place)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # [buckets, langs] log likelihoods; as many buckets as a power of two, at most 2^BITS
    uses: np.ndarray  # [scripts, langs]
    known: np.ndarray  # [scripts]: some language was learned with it

    def scores(self, w: Words) -> np.ndarray:
        """[words, langs], at most 0 and at least -CLIP; the best language of each word has 0."""
        if not len(w.begin) or not self.langs:
            return np.zeros((len(w.begin), len(self.langs)), np.float32)
        out = np.add.reduceat(self.table[w.bucket >> (BITS + 1 - len(self.table).bit_length())], w.begin, axis=0)
        out[~self.uses[w.script]] = -np.inf
        return np.maximum(out - out.max(axis=1, keepdims=True), -CLIP)


def path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best sequence of columns; ties keep the column before, then the smaller one."""
    n, m = scores.shape
    best = int(scores.sum(axis=0, dtype=np.float64).argmax())
    if m == 1:
        return np.zeros(n, np.int64)
    gain = np.cumsum(scores.astype(np.float64) - scores[:, best : best + 1], axis=0)
    if (gain - np.minimum(np.minimum.accumulate(gain, axis=0), 0)).max(initial=0) <= switch / 2:
        return np.full(n, best)
    total, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(total)
        at, least = total.index(top), top - switch
        back.append([j if total[j] >= least else at for j in range(m)])
        total = [(t if t >= least else least) + s for t, s in zip(total, row, strict=True)]
    out = [total.index(max(total))]
    for row in reversed(back):
        out.append(row[out[-1]])
    return np.array(out[::-1])


def train(docs: DataFrame, text_col: str, lang_col: str, key: Column, sample: int = SAMPLE, cells: int = CELLS) -> Model:
    """Fits a model on about `sample` rows of each language (those of the smallest hashes of `key`); rows without
    text or language are not used. No such rows: nothing is learned. All languages are learned; where they are so
    many that the model would have over `cells` numbers, trigrams share buckets."""
    attach(docs.sparkSession)
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(key).alias("place"))
    counts = sorted((r.lang, r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())  # one row for each language
    if not counts:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((len(NAMES), 0), bool), np.zeros(len(NAMES), bool))
    bits = max(1, min(BITS, (cells // len(counts)).bit_length() - 1))
    most = docs.sparkSession.createDataFrame([(k, min(int(min(1.0, sample / n) * 2**64), 2**64 - 1) - 2**63) for k, n in counts], "lang string, most long")
    chosen = rows.join(F.broadcast(most), "lang").where(F.col("place") <= F.col("most")).select("text", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    w = words_of([t for t, x in zip(texts, langs, strict=True) if x == lang])
                    bucket, n = np.unique(w.bucket >> (BITS - bits), return_counts=True)
                    scripts = np.bincount(w.script, weights=w.letters, minlength=len(NAMES)).astype("<i8")
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (lang, bucket.astype("<i4").tobytes(), n.astype("<i8").tobytes(), scripts.tobytes())], names=["lang", "bucket", "n", "scripts"])

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scripts = np.zeros(1 << bits, "<i8"), np.zeros(len(NAMES), "<i8")
        for batch in batches:
            for b, n, s in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "scripts")), strict=True):
                np.add.at(total, np.frombuffer(b, "<i4"), np.frombuffer(n, "<i8"))
                scripts += np.frombuffer(s, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (key[0].as_py(), total.tobytes(), scripts.tobytes())], names=["lang", "n", "scripts"])

    got = sorted(chosen.mapInArrow(counted, "lang string, bucket binary, n binary, scripts binary").groupBy("lang").applyInArrow(merged, "lang string, n binary, scripts binary").collect())
    n = np.stack([np.frombuffer(r.n, "<i8") for r in got], axis=1)
    s = np.stack([np.frombuffer(r.scripts, "<i8") for r in got], axis=1)
    table = np.log((n + 0.1) / (n.sum(axis=0) + 0.1 * (1 << bits))).astype(np.float32)
    uses = s >= np.maximum(1, SHARE * s.sum(axis=0))
    known = uses.any(axis=1)
    uses[~known] = True  # nobody's script: every language stays a candidate
    return Model([r.lang for r in got], table, uses, known)


SPANS = "lang_pred string, score double, spans array<struct<start:int,stop:int,lang:string>>"


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), switch: float = SWITCH) -> DataFrame:
    """The columns named in `keep`, as a struct `kept`, then lang_pred, score, spans; a row for each row.

    lang_pred: the language with most letters on the best path (ties: the first in order), `und` if
    the text is null, has no letter, or nothing was learned. score: its share of the letters (`und`: 0);
    letters of a script that no language was learned with count for none, so such a text has a low score.
    spans: code points from the first to after the last word of each stretch of one language.
    Whole texts are read, a very long one as a step of its own. Repeated rows are predicted again; an empty table gives no rows.
    """
    attach(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most CELLS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch, 1, 1 << 19):
                w, langs, share, spans = words_of(part.column(1).to_pylist()), [], [], []
                scores = m.scores(w)
                for i in range(part.num_rows):
                    own = slice(w.cut[i], w.cut[i + 1])
                    letters = w.letters[own]
                    total = int(letters.sum())
                    if not total or not m.langs:
                        langs.append("und")
                        share.append(0.0)
                        spans.append([])
                        continue
                    best = path(scores[own], switch)
                    by = np.bincount(best, weights=letters, minlength=len(m.langs))
                    top = int(by.argmax())
                    cut = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
                    place, stop = w.place[own], (w.place + w.length)[own] if len(cut) > 2 else None
                    stop = stop if stop is not None else [int(w.place[own.stop - 1] + w.length[own.stop - 1])]
                    langs.append(m.langs[top])
                    share.append(float((letters * m.known[w.script[own]])[best == top].sum()) / total)
                    spans.append([{"start": int(place[a]), "stop": int(stop[b - 1] if len(cut) > 2 else stop[0]), "lang": m.langs[int(best[a])]} for a, b in zip(cut, cut[1:])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(share, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())])))], names=["kept", "lang_pred", "score", "spans"])

    rows = docs.select(F.struct(*[exactly(c).alias(c) for c in keep]).alias("kept"), exactly(text_col).alias("text"))
    from pyspark.sql import types as T

    schema = T.StructType([rows.schema["kept"], *T._parse_datatype_string(SPANS).fields])
    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 by 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Learns from the labelled rows that are not held out, then predicts every row.

    A null or empty text is `und`; a null id is as good as any; repeated rows are predicted again; where all labels
    are null nothing is learned and all is `und`; an empty table gives no rows; other columns may have any names."""
    model = train(docs.where(~held_out(id_col)), text_col, lang_col, F.col(id_col))
    return predict(docs, model, text_col, keep or (id_col,))
