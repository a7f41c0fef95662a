"""Subtitle files that are keyword lists, link lists or product tags instead of speech.

Each text is stripped of cue numbers, times and mark-up and measured in blocks of a
fixed number of characters, the last with what is left: the compressed size of a block
over its length, with code points as single symbols so that scripts compare. The logarithm
of this ratio is normalized by length and language: what is usual for a block of its length
is a curve through the medians of the whole corpus, one for each script, and each language
of a script has a level of its own (``Usual``). The mean excess over a document's blocks, by
their length, is its redundancy (below 0). Redundancy flags a document, a low density of
sentence punctuation confirms it, and both count together: the fewer lines end like
sentences, the less redundancy it takes. ``score`` is redundancy (``MOST`` at most) plus ``ENDS_WEIGHT`` times
the share of lines that end like sentences; below ``SURE`` a document of ``SURE_WORDS`` words
is a case, above ``FLAGGED`` it is none. Between the two a check follows: words of documents that are surely
cases and of those that surely aren't, counted over the whole corpus, say which lines speak
for lists, and a flagged document is a case if most of its words stand in such lines.

Defined results: null, empty and blank texts and texts of fewer than ``2 * MIN_WORDS`` words
are no cases; where fewer than ``MIN_WORDS`` of a flagged document's words are known, ``LIMIT``
decides; texts of any length are read whole; repeated rows are judged alike; an empty table
gives no rows; columns besides ``doc_id, text, lang`` are ignored.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histospark.llm.bpe import chunks
from histospark.runtime import over, stage

#: Characters of a block.
BLOCK = 600
#: Weight of the share of lines that end like sentences beside the logarithm of redundancy.
ENDS_WEIGHT = 2.0
#: Scores below which a document is surely a case, is one if no check can be made, and is flagged for the check.
SURE, LIMIT, FLAGGED = 0.5, 0.88, 1.3
#: Words that a document needs to be surely a case: compression says little about shorter ones.
SURE_WORDS = 24
#: Redundancy below which more of it doesn't count: a refrain may be as redundant as can be, and punctuation must confirm.
MOST = -1.0
#: Block lengths are binned by this many steps a doubling.
STEPS = 3
#: Blocks by which a script's curve and a language's level are held to that of all.
HELD = 30.0
#: A word counts for the check if it is in this share of all documents, and in two at least.
#: The number of such words is at most the mean number of words of a document over this share.
MIN_SHARE = 1e-4
MIN_WORDS = 4
#: Pseudo-documents, shared out at the base rate, by which rare words are held to 0.
PSEUDO = 8.0
MAX_SCORE = 4.0

_invisible = regex.compile(r"[\p{Cf}\p{Cc}--[\t\n\r]]+", regex.V1)
_time = re.compile(r"^[^\n]*(?:-->|\d{1,2}[:：]\d{2}[:：.,]\d{2})[^\n]*$", re.M)
_marks = re.compile(r"\{[^}\n]{0,40}\}|</?[a-zA-Z][^>\n]{0,80}>")
_number = re.compile(r"^\W*\d*\W*$", re.M)
_spaced = re.compile(r"(?<!\S)(?:\S[ \t]{1,3}){4,}\S(?!\S)")
_word = re.compile(r"[\w'’]+|[★#@%$€£¥|/&=]|\n")
_cjk = re.compile("[぀-ヿ㐀-鿿]")
_digit = re.compile(r"\d")
_runs = re.compile(r"\d+|[^\d]+")
_end = re.compile(r"[.!?…。？！।؟;\"”»)\]♪♫*][ \t]*(?:\n|$)")
# what single bytes of a misread text look like: Latin-1, and what cp1252 has in place of controls
_high = re.compile("[\u0080-ÿ€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")


def _single(e: UnicodeError) -> tuple[bytes, int]:
    c = ord(e.object[e.start])
    # of the bytes that cp1252 leaves out and a careless reader loses, 81 is by far the most frequent in UTF-8
    return bytes([c]) if c < 256 else b"\x81" if c == 0xFFFD else b"?", e.start + 1


codecs.register_error("histospark-single", _single)


def repaired(text: str, lang: str | None) -> str:
    """A text whose bytes were once read in the wrong encoding, read in the likely one."""
    for _ in range(2):
        high = len(_high.findall(text))
        if high < 0.04 * len(text):
            return text
        raw = text.encode("cp1252", "histospark-single")
        utf8 = raw.decode("utf-8", "replace")
        if utf8.count("\ufffd") < 0.2 * high:
            text = utf8
            continue
        if high > 0.4 * len(text):
            return raw.decode("cp1253" if (lang or "").lower()[:2] in ("el", "gr") else "cp1251", "replace")
        return text
    return text


def plain_lines(text: str, lang: str | None = None) -> str:
    """Lower-case lines of the words that are shown: without cue numbers, times, mark-up and blanks."""
    text = _invisible.sub("", repaired(text, lang)).replace("\r\n", "\n").replace("\r", "\n")
    text = _marks.sub("", text)
    text = _number.sub("", _time.sub("", text))
    return re.sub(r"\s*\n\s*", "\n", text).strip().lower()


def block_sizes(body: str) -> tuple[list[int], list[int]]:
    """Lengths and compressed sizes of the blocks of a text, code points being single symbols.

    A rest of at most half a block belongs to the last block."""
    points = np.frombuffer(body.encode("utf-32-le"), np.uint32)
    symbols = np.unique(points, return_inverse=True)[1]
    raw = symbols.astype(np.uint8 if symbols.max(initial=0) < 256 else np.uint16)
    starts = range(0, max(1, len(raw) - BLOCK // 2), BLOCK)
    ends = [*starts[1:], len(raw)]
    return [j - i for i, j in zip(starts, ends)], [len(zlib.compress(raw[i:j].tobytes(), 6)) for i, j in zip(starts, ends)]


def _hash(word: str) -> int:
    return xxhash.xxh32_intdigest(word) % (2**31 - 1) + 1


_SPACED = "spaced_out_word"
NEWLINE, NUMBER, SPACED = 0, _hash("\x01n"), _hash("\x01s")
_FIXED = {"\n": (NEWLINE,), _SPACED: (SPACED,)}


class Tokens:
    """Words of lines as hashes; 0 ends a line."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = dict(_FIXED)

    def _make(self, w: str) -> tuple[int, ...]:
        if _cjk.search(w):
            w = _digit.sub("", w)
            return tuple(_hash(w[i : i + 2]) for i in range(max(1, len(w) - 1)))
        if _digit.search(w):
            return (NUMBER,) if w.isdigit() else (_hash("\x01" + _runs.sub(lambda m: "0" if m[0][0].isdigit() else "a", w)),)
        return (_hash(w),)

    def of(self, body: str) -> list[int]:
        if len(self.known) > 300_000:
            self.known = dict(_FIXED)
        known, out = self.known, []
        for w in _word.findall(_spaced.sub(f" {_SPACED} ", body)):
            ids = known.get(w)
            if ids is None:
                ids = known[w] = self._make(w)
            out += ids
        return out


def _script(body: str) -> str:
    """The range of code points that most of the text's letters are of."""
    sample = np.frombuffer(body.encode("utf-32-le"), np.uint32)
    letters = sample[sample > 0x40]
    if not len(letters):
        return "none"
    edges = (0x250, 0x370, 0x400, 0x530, 0x590, 0x900, 0xE00, 0x3040, 0xA000)
    return str(int(np.bincount(np.searchsorted(edges, letters, "right"), minlength=1).argmax()))


_MEASURED = "doc_id bigint, script string, lang string, n_words int, ends double, lengths array<int>, sizes array<int>, tokens array<int>"


def _lists(values: list, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else [], kind))


def measure(documents: DataFrame) -> DataFrame:
    """Of every document with text: script, recorded language, words, sentence ends, block lengths and sizes, word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Tokens()
        for batch in chunks(batches, 1):
            rows = []
            for doc, text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                body = plain_lines(text, lang) if text else ""
                if not body:
                    continue
                tokens = np.array(words.of(body), np.int32)
                code = (lang or "").strip().lower()[:2]
                rows.append((doc, _script(body), code if code.isascii() and code.isalpha() else "", int((tokens > 0).sum()), len(_end.findall(body)) / (body.count("\n") + 1), *block_sizes(body), tokens))
            doc, script, lang, n, ends, lengths, sizes, tokens = map(list, zip(*rows)) if rows else ([],) * 8
            columns = [pa.array(doc, pa.int64()), pa.array(script, pa.string()), pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(ends, pa.float64()), _lists(lengths, pa.int32()), _lists(sizes, pa.int32()), _lists(tokens, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _MEASURED.split(", ")])

    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return rows.mapInArrow(run, _MEASURED)


class Usual:
    """The usual logarithm of the compression ratio by length, script and language.

    ``medians`` has ``script, lang, bin, n, y``: the number of blocks and their median. A quadratic in
    the logarithm of the length is fitted to all, each script's deviation from it is fitted with
    ``HELD`` blocks of no deviation, and so is each language's level within its script."""

    def __init__(self, medians: pd.DataFrame) -> None:
        self.rows: list[tuple[str, str, float, float, float]] = []
        if medians.empty:
            return
        x, y, n = medians["bin"].to_numpy(float) / STEPS, medians["y"].to_numpy(float), medians["n"].to_numpy(float)
        self.middle = float(np.average(x, weights=n))
        basis = np.vander(x - self.middle, 3, increasing=True)

        def fit(rows: np.ndarray, left: np.ndarray, degree: int) -> np.ndarray:
            b, w = basis[rows][:, : degree + 1], n[rows]
            c = np.linalg.solve(b.T @ (b * w[:, None]) + np.eye(degree + 1) * HELD, b.T @ (w * left[rows]))
            return np.pad(c, (0, 2 - degree))

        every = np.arange(len(x))
        b = basis * np.sqrt(n)[:, None]
        pooled = np.linalg.lstsq(b, y * np.sqrt(n), rcond=None)[0]
        script = medians["script"].to_numpy()
        for s in np.unique(script):
            own = every[script == s]
            curve = pooled + fit(own, y - basis @ pooled, 2)
            lang = medians["lang"].to_numpy()[own]
            for code in np.unique(lang):
                level = curve + fit(own[lang == code], y - basis @ curve, 0)
                self.rows.append((str(s), str(code), *(float(v) for v in level)))

    def table(self, like: DataFrame) -> DataFrame:
        """A row of three coefficients for each script and two-letter code: at most some thousands."""
        return like.sparkSession.createDataFrame(self.rows, "script string, lang string, c0 double, c1 double, c2 double")


def _bin(length: Column) -> Column:
    return F.round(F.log2(length) * STEPS).cast("int")


def scored(measured: DataFrame) -> DataFrame:
    """``measured`` with ``redundancy`` and ``score``."""
    blocks = measured.select("script", "lang", F.explode(F.arrays_zip("lengths", "sizes")).alias("b"))
    y = F.log(F.col("b.sizes") / F.col("b.lengths"))
    medians = blocks.groupBy("script", "lang", _bin(F.col("b.lengths")).alias("bin")).agg(F.count("*").alias("n"), F.percentile_approx(y, 0.5, 1000).alias("y"))
    # scripts, two-letter codes and bins of lengths up to one and a half blocks: a bounded table
    usual = Usual(medians.toPandas())
    middle = usual.middle if usual.rows else 0.0
    x = lambda b: F.log2(b["lengths"].cast("double")) - middle
    excess = F.aggregate(F.arrays_zip("lengths", "sizes"), F.lit(0.0), lambda a, b: a + b["lengths"] * (F.log(b["sizes"] / b["lengths"]) - F.col("c0") - F.col("c1") * x(b) - F.col("c2") * x(b) * x(b)))
    total = F.aggregate("lengths", F.lit(0.0), lambda a, b: a + b)
    rows = measured.join(F.broadcast(usual.table(measured)), ["script", "lang"]).withColumn("redundancy", over(excess, total))
    return rows.withColumn("score", F.greatest("redundancy", F.lit(MOST)) + ENDS_WEIGHT * F.col("ends")).drop("c0", "c1", "c2")


class Lexicon:
    """Words and what they speak for: above 0 for lists, below for speech."""

    def __init__(self, counts: pd.DataFrame, lists: int, speech: int) -> None:
        a, b = counts["lists"].to_numpy(float), counts["speech"].to_numpy(float)
        base = lists / max(1, lists + speech)
        rate = ((a + PSEUDO * base) / max(1, lists)) / ((b + PSEUDO * (1 - base)) / max(1, speech))
        score = np.clip(np.log(rate), -MAX_SCORE, MAX_SCORE) if lists and speech else np.zeros(len(a))
        order = np.argsort(counts["word"].to_numpy())
        self.words, self.scores = counts["word"].to_numpy(np.int32)[order], score[order].astype(np.float32)

    def list_share(self, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each document, the share of words in lines that speak for lists, and the words known."""
        n = len(starts) - 1
        if not len(tokens) or not len(self.words):
            return np.zeros(n), np.zeros(n)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        known = self.words[at] == tokens
        score = np.where(known, self.scores[at], 0.0)
        word = tokens > 0
        doc = np.repeat(np.arange(n), np.diff(starts))
        line = np.cumsum(~word) + doc  # documents don't share lines
        total, size, sure = np.bincount(line, score), np.bincount(line, word), np.bincount(line, known & word)
        owner = np.zeros(len(total), np.int64)
        owner[line] = doc
        size = np.where(sure > 0, size, 0)  # a line of which no word is known says nothing
        listed = np.bincount(owner, np.where(total > 0.5, size, 0), n)
        return listed / np.maximum(1, np.bincount(owner, size, n)), np.bincount(doc, known & word, n)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    starts = np.asarray(column.offsets)
    return np.asarray(column.values)[starts[0] : starts[-1]], starts - starts[0]


def _counted(labelled: DataFrame) -> tuple[pd.DataFrame, int, int]:
    """Per word the number of list and of speech documents; ``labelled`` has ``tokens, label``.

    Tasks count their own batches first. What reaches the driver is bounded by MIN_SHARE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, starts = _flat(batch.column(0))
            label = np.asarray(batch.column(1))
            doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            pairs = np.unique(doc[tokens > 0] * (1 << 32) + tokens[tokens > 0])
            word, label_of = pairs & 0xFFFFFFFF, label[pairs >> 32]
            words, at = np.unique(word, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(np.bincount(at, label_of == 1).astype(np.int64)), pa.array(np.bincount(at, label_of == 0).astype(np.int64))], ["word", "lists", "speech"])

    totals = labelled.agg(F.count(F.when(F.col("label") == 1, 1)).alias("a"), F.count(F.when(F.col("label") == 0, 1)).alias("b")).first()
    least = max(2.0, MIN_SHARE * (totals.a + totals.b))
    words = labelled.select("tokens", "label").where("label >= 0").mapInArrow(run, "word int, lists bigint, speech bigint")
    counts = words.groupBy("word").agg(F.sum("lists").alias("lists"), F.sum("speech").alias("speech")).where(F.col("lists") + F.col("speech") >= least)
    return counts.toArrow().to_pandas(), totals.a, totals.b


def _shares(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, list_share, n_known`` of ``rows``."""
    held = rows.sparkSession.sparkContext.broadcast((lexicon.words, lexicon.scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon.__new__(Lexicon)
        own.words, own.scores = held.value
        for batch in batches:
            share, known = own.list_share(*_flat(batch.column(6)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(share, pa.float64()), pa.array(known.astype(np.int32))], [*batch.schema.names[:6], "list_share", "n_known"])

    return rows.select(*_JUDGED, "tokens").mapInArrow(run, "doc_id bigint, n_words int, redundancy double, ends double, score double, enough boolean, list_share double, n_known int")


_JUDGED = ["doc_id", "n_words", "redundancy", "ends", "score", "enough"]


def judge(documents: DataFrame) -> DataFrame:
    """``doc_id, n_words, redundancy, ends, score, list_share, is_list`` of every document with text.

    ``list_share`` is the result of the check, NULL where none is made."""
    rows = scored(stage(measure(documents))).withColumn("enough", F.col("n_words") >= 2 * MIN_WORDS)
    score = F.col("score")
    sure = (score < SURE) & (F.col("n_words") >= SURE_WORDS)
    lexicon = Lexicon(*_counted(rows.withColumn("label", F.when(sure, 1).when(score >= FLAGGED, 0).otherwise(-1))))
    unsure = F.col("enough") & (score < FLAGGED) & ~sure
    checked = _shares(rows.where(unsure), lexicon)
    verdict = F.when(F.col("n_known") >= MIN_WORDS, F.col("list_share") > 0.5).otherwise(score < LIMIT)
    clear = rows.where(~unsure).select(*_JUDGED, F.lit(None).cast("double").alias("list_share"), sure.alias("is_list"))
    return clear.unionByName(checked.select(*_JUDGED, "list_share", verdict.alias("is_list"))).drop("enough")


def list_pages(documents: DataFrame) -> DataFrame:
    """``doc_id`` of each document that is no speech but lists."""
    return judge(documents).where("is_list").select("doc_id").distinct()
