"""Template residue, filler, failure messages and demands for scripts in place of content.

A regularised linear classifier judges every segment (sentence or line) of a text by hashed word
n-grams, its length, whether it is a title, whether it has an open or a quoted slot, and how far it
repeats itself or another segment. Weak labels come from response-status lines and phrases, open
slots among them: the segments of short texts that show one are taken as residue, those of longer
texts without any as content. Phrases that content merely quotes, and notices that end whole
texts, occur in the latter too and so get no weight. The classifier is fitted on a bounded sample
of labelled texts and validated on sources it has not seen; every text is then judged whole.

A text is residue if the classifier takes a segment with a slot as residue, or some segments beside
two content sentences at most. Segments are cut, hashed and scored with array operations.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.llm.near_duplicates import mixed, range_sums
from litmill.session import settle, spread

#: Texts (expected number, chosen by hash of the id) that may be labelled for fitting, the share of them that may be
#: labelled as content, and how many of either label are used.
SAMPLE_ROWS, CONTENT_SHARE, SAMPLE_TEXTS = 40_000, 0.25, 4000
#: Greatest length (characters) of a text labelled as residue and as content. Texts of any length are judged.
SHORT_CHARS, LONG_CHARS = 1500, 6000
#: One in so many sources is held out for validation.
HELD_OUT = 5
DIM = 1 << 16
#: Features at the end of the weights that are no n-grams: length and title, repetition, slots.
SHAPES, REPEATS, SLOTS = 16, 12, 2
#: Value of a slot's feature: one slot is to count within a long sentence too.
SLOT_VALUE = 5.0
GRAMS = DIM - SHAPES - REPEATS - SLOTS
L2, ROUNDS, STEP = 1e-5, 120, 0.15
#: Weight of the residue segments in the fit; content has the rest.
RESIDUE_SHARE = 0.2
#: Letters worked on at once.
SLICE = 1_000_000

# Forms of unfilled slots, and what makes a slot a quoted one.
SLOT = re.compile(
    r"\{\{[^{}\n]{0,40}\}\}|\$\{[^{}\n]{0,40}\}|<%[^%\n]{0,40}%>|\{%[^%\n]{0,40}%\}|<<[^<>\n]{1,40}>>|\[\[[^\[\]\n]{1,40}\]\]|@@[\w.\- ]{1,40}@@"
    r"|(?<![\w%])%[A-Za-z][\w.\-]{1,40}%|(?<![\w#])#[A-Za-z][\w.\-]{1,40}#|\{[A-Za-z][\w.\-]{1,40}\}|(?<![\w$])\$[a-z][a-z]+(?:[_.\-][a-z]+)*\b|(?<!\w)__[A-Za-z][\w.\-]{0,40}?__(?!\w)|(?<![\w:]):[a-z]+(?:[_.\-][a-z]+)*:(?![\w:])"
    r"|\[(?:your|insert|enter|add|fill in|type)\b[^\[\]\n]{0,40}\]|\[[^\[\]\n]{1,40}(?:\bhere|to be added|to follow|\?)\]"
    r"|(?<!\w)_{3,}(?!\w)|\bX{2,4}\b(?![-\w])|\((?:tba|tbd|tbc)\)|(?<!\w)(?:TBC|TBD|TBA)\b|(?<!\?)\?{2,4}(?!\?)|(?<!\.)\.{5,8}(?!\.)",
    re.IGNORECASE,
)
#: What a text with a slot has at least; texts without are not searched for slots.
MAY_SLOT = re.compile(r"[{$@#_]|:[a-z._-]+:|<[<%]|\[|%[A-Za-z]|XX|xx|\([tT][bB]|[tT][bB][aAcCdD]\b|\?\?|\.{5}")
QUOTED = re.compile(r"(?:placeholders?|templates?|variables?|tokens?|fields?|tags?|macros?|strings?|of the form|such as|called|named|denotes?|cells and|literal|syntax)\W*$", re.IGNORECASE)
# Lines and phrases that a failed response, an empty record, filler or a script demand shows.
LINES = [
    r"\W*(?:http|error|status|code)*\W*[45]\d\d(?:\W+[a-z][a-z ]{0,30})?\W*$",
    r"\W*(?:access denied|forbidden|unauthori[sz]ed|bad gateway|gateway time-?out|service unavailable|internal server error|page not found|not found|gone|oops|sorry|whoops[^\n]{0,40})\W*$",
    r"\s+at [\w.$]+\([\w.]+:\d+\)",
    r"\s*\{[^{}\n]*\x22(?:error|exception|errors|errorcode)\x22\s*:[^{}\n]*\}\s*$",
    r"\w+: (?:nan|undefined|null|none|\{\})\W*$",
    r"\W*(?:(?:sample|dummy|filler|placeholder|example|test) (?:text|paragraph|abstract|content|summary|caption)|(?:abstract|body text|text|content|summary|caption|description) (?:follows|to follow|coming soon|goes here)|under construction|coming soon|todo\b[^\n]{0,40})(?:\W|$)",
]
PHRASES = [
    r"\b(?:request|incident|event|ray|error) id\b\W{0,3}\w*\d|\breference:? [0-9a-f]{6,}\b",
    r"traceback \(most recent call last\)|sqlstate\[|exception in thread|stack trace:|\bfatal error\b|\bon line \d+\W*$|segmentation fault|\w(?:exception|error)\b[^\n]{0,60}\bat [\w.$]+\([\w.]+:\d+\)",
    r"\[object object\]|#(?:ref|value|name|n/a)!|%s\b[^\n]{0,60}%s|undefined (?:views|reads|downloads|citations)",
    r"\blorem ipsum dolor\b|\b(?:consectetur|adipiscing|incididunt|exercitation)\b|(?:\bxxx\b\W*){3,}|heading 1 heading 2|with your own words|description to follow",
    r"\bbla(?:h)?\W+bla(?:h)?\b|\bfoo\W+bar\b|\basdf\b|\bqwer(?:ty)?\b|\bhjkl\b|click to (?:add|edit)|intentionally (?:a stand-in|left blank|blank)|\bnoscript:",
    r"(?:your|enter|insert|add|type) (?:text|title|abstract|content)s?(?: goes)? here\b",
    r"(?:platzhalter|beispiel|blind|muster)text|text folgt|hier steht|texto de (?:ejemplo|relleno)|escriba su|texte? (?:d'exemple|factice|ici)|votre texte|testo di (?:esempio|prova)|示例文本|此处填写|在此(?:输入|填写)|占位|待补充",
    r"(?:javascript|scripts?|cookies|browser)[^.\n]{0,40}(?:is|are|seems?|appears?|turned|switched)[^.\n]{0,20}\b(?:off|disabled|blocked|needed|required)\b",
    r"(?:enable|activate|allow|turn on|switch on|accept)\b[^.\n]{0,20}(?:javascript|scripts?|cookies)[^.\n]{0,30}(?:continue|view|read|proceed|access|and (?:reload|refresh|try))",
    r"(?:aktivieren|activez|active|habilite|attivare|attiva|ative|启用|开启)[^.\n]{0,20}(?:javascript|cookies)",
    r"(?:requires?|needs?|only with|depends on|works? with)[^.\n]{0,20}(?:javascript|scripts|cookies|script-capable)[^,\n]{0,30}\.|verify your browser|check your browser|you are (?:a )?human|javascript[^a-z]{0,12}$",
]
#: What a text that has one of the phrases holds at least, in lower case: most texts hold none and are not searched for them.
HINTS = [
    "request id", "incident id", "event id", "ray id", "error id", "reference", "traceback", "sqlstate", "exception", "stack trace", "error", "on line ", "segmentation fault", "[object", "#ref!", "#value!", "#name!", "#n/a!",
    "%s", "undefined ", "lorem", "consectetur", "adipiscing", "incididunt", "exercitation", "xxx", "heading 1", "own words", "to follow", "bla", "foo", "asdf", "qwer", "hjkl", "click to ", "intentionally ", "noscript", " here",
    "platzhaltertext", "beispieltext", "blindtext", "mustertext", "text folgt", "hier steht", "texto de ", "escriba su", "text d'exemple", "texte d'exemple", "factice", "texte ici", "text ici", "votre texte", "testo di ",
    "示例文本", "此处填写", "在此", "占位", "待补充", "script", "cookie", "browser", "human",
]
LINE_STATUS = "(?im)^(?:" + "|".join(LINES) + ")"
STATUS = LINE_STATUS + "|" + "|".join(PHRASES)
_STATUS = re.compile(STATUS)

# Kinds of characters: part of a word, digit, a word of its own, mark.
_WORD, _DIGIT, _SIGN, _MARK = 1, 2, 3, 4


def _kinds() -> np.ndarray:
    out = np.zeros(1 << 16, dtype=np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if "a" <= c <= "z" or "à" <= c <= "ÿ" and c != "÷" or c in "œß":
            out[i] = _WORD
        elif "0" <= c <= "9":
            out[i] = _DIGIT
        elif "一" <= c <= "鿿":
            out[i] = _SIGN
        elif not c.isspace() and not c.isalnum() and c != "_" and not 0xD800 <= i < 0xE000:
            out[i] = _MARK
    return out


_KIND = _kinds()
_SPACE = np.array([chr(i).isspace() for i in range(1 << 16)])
_BASE, _DIGITS = 0xD6E8FEB86659FD93, np.uint64(0x0DD5)
_CLOSERS = np.array([ord(c) for c in "\"'”’)]"])
_SLOTMARK, _SLOTNAME = "slotmark", "slotname"


def mark_slots(text: str) -> str:
    """Slots become the word slotmark, quoted ones slotname."""
    if not MAY_SLOT.search(text):
        return text

    def mark(m: re.Match) -> str:
        return f" {_SLOTNAME} " if QUOTED.search(text, max(0, m.start() - 40), m.start()) else f" {_SLOTMARK} "

    return SLOT.sub(mark, text)


class Segments:
    """The segments of texts: hashed words, where each starts and ends, which text it belongs to, and its features."""

    def __init__(self, texts: list[str | None]) -> None:
        marked = [mark_slots(t).lower() if t else "" for t in texts]
        self.n_texts = len(texts)
        self.letters = np.frombuffer("\n".join([*marked, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        x = np.minimum(self.letters, 0xFFFF)
        kind = _KIND[x]
        before, after = np.concatenate([[0], kind[:-1]]), np.concatenate([kind[1:], [0]])
        starts = np.flatnonzero((kind > 0) & ((kind != before) | (kind >= _SIGN)))
        ends = np.flatnonzero((kind > 0) & ((kind != after) | (kind >= _SIGN))) + 1
        h = mixed(range_sums(self.letters.astype(np.uint64), starts, ends, _BASE))
        k = kind[starts]
        self.hashes = np.where(k == _DIGIT, _DIGITS, h)
        # A segment ends behind the last of its closing marks if a blank follows, behind any other such mark and at line ends.
        full, half = np.isin(x, [ord(c) for c in "。！？"]), np.isin(x, [ord(c) for c in ".!?"])
        blank, mark = np.concatenate([_SPACE[x[1:]], [True]]), full | half
        cut = (x == 10) | (mark & ~np.concatenate([mark[1:], [False]]) & (full | blank))
        place = np.concatenate([[0], np.cumsum(cut)[:-1]])[starts]
        new = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, dtype=bool)
        self.seg = np.cumsum(new) - 1  # of each word
        self.n = int(new.sum())
        self.first_word = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.first_word, len(starts)))
        self.from_, self.to = starts[self.first_word], ends[np.append(self.first_word[1:], len(starts)) - 1] if self.n else ends[:0]
        text_ends = np.cumsum([len(m) + 1 for m in marked])
        self.owner = np.searchsorted(text_ends, self.from_, side="right")
        self.first = np.concatenate([[True], self.owner[1:] != self.owner[:-1]]) if self.n else np.zeros(0, dtype=bool)
        # Whether a segment ends as a sentence does: its last word, but for closing marks behind it, is such a mark.
        last = np.append(self.first_word[1:], len(starts)) - 1 if self.n else np.zeros(0, dtype=np.int64)
        for _ in range(3):
            step = np.isin(x[starts[last]], _CLOSERS) & (last > self.first_word)
            last = last - step
        self.ends = mark[starts[last]] if self.n else np.zeros(0, dtype=bool)
        count = lambda w: np.bincount(self.seg, w, minlength=self.n)
        self.words = (count((k == _WORD) | (k == _DIGIT)) + count(k == _SIGN) // 3).astype(np.int64)
        slots = {w: mixed(range_sums(np.array([ord(c) for c in w], dtype=np.uint64), np.array([0]), np.array([len(w)]), _BASE))[0] for w in (_SLOTMARK, _SLOTNAME)}
        self.slot, self.named = (count(self.hashes == slots[w]) > 0 for w in (_SLOTMARK, _SLOTNAME))

    def text(self, i: int) -> str:
        """The i-th segment, lower-case, with slots marked."""
        return self.letters[self.from_[i] : self.to[i]].tobytes().decode("utf-32-le", "surrogatepass")

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(indices, segment of each, value of each): a segment's n-grams share a weight of one, so that length counts by its own feature only."""
        h, seg = self.hashes, self.seg
        pair = seg[1:] == seg[:-1] if len(seg) else np.zeros(0, dtype=bool)
        two = (h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])[pair]
        gram = lambda x: (mixed(x) % np.uint64(GRAMS)).astype(np.int64)
        norm = 1.0 / np.sqrt(2.0 * self.sizes + 1.0)
        every = np.arange(self.n)
        shape = np.minimum(np.log2(self.sizes + 1).astype(np.int64), 7) + 8 * (self.first & ~self.ends)
        # Words said again within the segment, and whether the text has the segment more than once.
        order = np.lexsort((h, seg))
        fresh = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (seg[order][1:] != seg[order][:-1])]) if len(h) else np.zeros(0, dtype=bool)
        distinct = np.bincount(seg[order][fresh], minlength=self.n)
        again = np.digitize(self.sizes / np.maximum(distinct, 1), [1.34, 1.6, 2, 2.8, 4])
        whole = mixed(range_sums(h, self.first_word, self.first_word + self.sizes, 0x9DDFEA08EB382D69)) ^ mixed(self.owner.astype(np.uint64))
        _, back, times = np.unique(whole, return_inverse=True, return_counts=True)
        repeat = again + 6 * (times[back] > 1)
        base = GRAMS
        parts = [(gram(h), seg, norm[seg]), (gram(two), seg[1:][pair], norm[seg[1:][pair]]), (base + shape, every, np.full(self.n, 0.5)), (base + SHAPES + repeat, every, np.full(self.n, 0.5))]
        for i, flag in enumerate((self.slot, self.named)):
            parts.append((np.full(int(flag.sum()), base + SHAPES + REPEATS + i), every[flag], np.full(int(flag.sum()), SLOT_VALUE)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def fit(idx: np.ndarray, row: np.ndarray, value: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty and balanced classes, by gradient steps with momentum scaling."""
    n, w, b = len(label), np.zeros(DIM), 0.0
    if not n or label.min() == label.max():
        return w, (5.0 if n and label.max() > 0 else -5.0)
    share = np.where(label > 0, RESIDUE_SHARE / label.sum(), (1 - RESIDUE_SHARE) / (n - label.sum()))
    m, v = np.zeros(DIM + 1), np.zeros(DIM + 1)
    for t in range(1, ROUNDS + 1):
        z = b + np.bincount(row, w[idx] * value, minlength=n)
        err = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - label) * share
        g = np.append(np.bincount(idx, err[row] * value, minlength=DIM) + L2 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def weak_label(text: Column, low: Column, content: Column) -> Column:
    """1 for short texts that show a status or phrase, 0 for longer texts and single lines that show none (where ``content`` allows), else null; ``low`` is the text in lower case."""
    n = F.length(text)
    sentences = F.size(F.split(text, r"[.!?。！？\n]+\s*"))
    short, long_ = (n <= SHORT_CHARS) & (sentences <= 9), content & (n <= LONG_CHARS) & ((sentences >= 6) | (sentences == 1))
    # Lengths come first, so that the pattern runs over texts that can be chosen only.
    hint = reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in HINTS])
    shows = F.when(short | long_, text.rlike(LINE_STATUS) | text.rlike(_JVM_SLOT) | (hint & text.rlike(STATUS)))
    return F.when(short & shows, 1).when(long_ & ~shows, 0)


#: The plainest open slots, for labels only.
_JVM_SLOT = r"\{\{[^{}\n]{0,40}\}\}|\$\{[^{}\n]{0,40}\}|<<[^<>\n]{1,40}>>|@@[\w.\- ]{1,40}@@|(?<!\w)__[A-Za-z][\w.\-]{0,40}?__(?!\w)|(?<![\w:]):[a-z]+(?:[_.\-][a-z]+)*:(?![\w:])|(?<![\w%])%[A-Za-z][\w.\-]{1,40}%|\{%[^%\n]{0,40}%\}"


def training_rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> pd.DataFrame:
    """The bounded labelled sample (host, label, text), chosen by hash of the id over all rows in one scan of the texts."""
    order = F.xxhash64(id_col, F.lit(11))
    n = max(docs.count(), 1)
    share = min(1.0, SAMPLE_ROWS / n)
    content = min(share, max(share * CONTENT_SHARE, SAMPLE_TEXTS / n))
    edge = lambda part: F.lit(min(int(part * 2**64), 2**64 - 1) - 2**63)
    drawn = docs.where(order <= edge(share)).select(F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"), order.alias("o"), F.col(id_col).alias("id"))
    # Written once, as both labels are read from it: of SAMPLE_ROWS texts those with a label.
    # Each generated column is made once; a plain one would be made again in the filter, and for every hint.
    once = lambda c: F.explode_outer(F.array(c))
    drawn = drawn.withColumn("low", once(F.lower("text")))
    drawn = drawn.withColumn("label", once(weak_label(F.col("text"), F.col("low"), F.col("o") <= edge(content)))).drop("low")
    labelled = settle(drawn.where("label is not null"))
    chosen = [labelled.where(F.col("label") == k).orderBy("o", "id").limit(SAMPLE_TEXTS) for k in (0, 1)]
    return chosen[0].unionByName(chosen[1]).orderBy("o", "id").select("host", "label", "text").toPandas()


def train(sample: pd.DataFrame, held_out: bool) -> tuple[np.ndarray, float, dict[str, float]]:
    """Weights, bias and, if some hosts are held out, how well their segments are told apart."""
    s = Segments(list(sample["text"]))
    label = sample["label"].to_numpy(dtype=np.float64)[s.owner] if s.n else np.zeros(0)
    # Titles and page furniture around a failure say nothing about it: of the texts that show one, only sentences and the
    # showing lines count; of those that show open slots only, the segments with slots.
    shows = np.array([y == 1 and bool(_STATUS.search(t)) for y, t in zip(sample["label"], sample["text"], strict=True)], dtype=bool)[s.owner] if s.n else np.zeros(0, dtype=bool)
    known = (label == 0) | s.slot | (shows & s.ends)
    for i in np.flatnonzero(shows & ~known):
        known[i] = bool(_STATUS.search(s.text(i)))
    label[s.slot] = 1.0
    idx, row, value = s.features()
    host = sample["host"].fillna("").map(lambda h: zlib.crc32(h.encode()) % HELD_OUT == 0).to_numpy(dtype=bool)
    test = known & (host[s.owner] if s.n and held_out else np.zeros(s.n, dtype=bool))
    used = known & ~test
    keep = used[row] if s.n else np.zeros(0, dtype=bool)
    place = np.cumsum(used) - 1
    w, b = fit(idx[keep], place[row[keep]], value[keep], label[used])
    out = {"texts": float(len(sample)), "segments": float(known.sum()), "held_out_segments": float(test.sum())}
    if test.any():
        z = (b + np.bincount(row, w[idx] * value, minlength=s.n))[test]
        y, said = label[test] > 0, z > SURE  # as texts are judged
        out["accuracy"] = float((said == y).mean())
        out["recall"] = float(said[y].mean()) if y.any() else 1.0
        out["precision"] = float(y[said].mean()) if said.any() else 1.0
    return w, b, out


#: Content sentences beside which residue segments still make a text residue.
MOST_CONTENT = 2
#: Score above which a segment is residue: labels miss whole forms of residue, not of content, so the even score of 0 is too high.
SURE = -0.5


def judge(texts: pd.Series, w: np.ndarray, b: float) -> pd.DataFrame:
    """Per text: segments with slots and other segments that are residue, content sentences, and whether it is residue."""
    s = Segments(list(texts))
    n = len(texts)
    idx, row, value = s.features()
    bad = b + np.bincount(row, w[idx] * value, minlength=s.n) > SURE
    sentence = s.ends & (s.words >= 5)
    count = lambda x: np.bincount(s.owner, x.astype(float), minlength=n).astype(int)
    slots, residue_, content = count(bad & s.slot), count(bad), count(sentence & ~bad)
    return pd.DataFrame({"slots": slots, "residue": residue_, "content": content, "is_residue": (slots > 0) | ((residue_ > 0) & (content <= MOST_CONTENT))})


def _stretches(texts: pd.Series) -> Iterator[tuple[int, int]]:
    size, lo = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > SLICE:
            yield lo, i
            size, lo = 0, i
        size += n + 1
    if lo < len(texts):
        yield lo, len(texts)


def residue(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, slots, residue, content, is_residue) of every row; null and empty texts are not residue.

    Without labelled texts of both kinds nothing, or all, is residue. Texts are judged whole. Other
    columns of ``docs`` are not read.
    """
    docs = spread(docs.select(id_col, text_col, host_col))
    w, b, _ = train(training_rows(docs, id_col, text_col, host_col), held_out=False)
    shared = docs.sparkSession.sparkContext.broadcast(w)  # DIM numbers, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        for df in batches:
            for lo, hi in _stretches(df["text"]):
                part = df.iloc[lo:hi].reset_index(drop=True)
                yield pd.concat([part[["id"]], judge(part["text"], weights, b)], axis=1)

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, slots int, residue int, content int, is_residue boolean")


def validation(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(measure, value): how segments of unseen hosts are told apart against their weak labels."""
    out = train(training_rows(docs, id_col, text_col, host_col), held_out=True)[2]
    return docs.sparkSession.createDataFrame(sorted(out.items()), "measure string, value double")
