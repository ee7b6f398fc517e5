"""Sentences of texts in several languages and scripts, by semi-Markov dynamic programming.

Texts are parted into blocks (paragraphs, headings, list items; fenced code falls out), and each block into sentence
spans: of all ways to choose among its possible ends, the one with the highest sum of span scores. A span is scored as a
whole, by its length, the words that open and close it and the balance of its quotation marks and brackets. What closes
and opens sentences is learned from all blocks: a word that never stands last in a block, however often an end mark
follows it, is no likely end, and one that never stands first is no likely beginning.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.session import written

# Words before a full stop that another word or number has to follow.
ABBREVIATIONS = frozenset(
    "Mr Mrs Ms Dr Prof St Fig Figs Sec Eq No Nos Vol vs e.g i.e approx ext cf "
    "Nr Abb Vgl vgl bzw ca Hr Fr Str Tel sog "
    "Sr Sra Srta Dra Ud Uds EE núm pág aprox ej art "
    "M Mme Mlle د ا م ص डॉ श्री श्रीमती".split()
)
# The German names of the months, which follow the number of a day.
MONTHS = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split())
# Words that take up a sentence again after a quotation.
RESUMING = frozenset("and but before after said asked wrote und aber sagte fragte y pero dijo preguntó और तो लेकिन कहा पूछा ثم و と って という".split())

_FULL = "。！？｡।॥؟…‼⁇⁈⁉．۔"
_BLANKLESS = "฀-ໟက-႟ក-៿々-〇ぁ-ヿ㐀-䶿一-鿿豈-﫿"
_NO_BLANK = frozenset(c for c in map(chr, range(0xE00, 0xFB00)) if re.match(f"[{_BLANKLESS}]", c))  # letters of scripts without blanks
_CJK = re.compile("[々-〇ぁ-ヿ㐀-䶿一-鿿]")
_CLOSERS = "\"”’»」』）)]】》〉"
_OPENERS = "\"“‘«„「『（([【《〈¿¡'"
_END = re.compile(rf"[.!?{_FULL}]+(?: \.\.\.)?")
_MARKS = re.compile(rf"[.!?{_FULL}]+")
_LAST_WORD = re.compile(r"[^\s(（\[\"“«]*$")
_NUMBER_BEFORE = re.compile(r"\d\s*\S*$")
_GAP = re.compile(rf"(?<=[{_BLANKLESS}])[ 　\t]+(?=[{_BLANKLESS}])")
_WIDE_GAP = re.compile(r"(?<=\S)[ 　\t]+(?=\S)")
_GOES_ON = re.compile(r"\s*[,;:，、；：،؛)\]）】」』]")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|$)")
_HEADING = re.compile(r"\s{0,3}#{1,6}(?:\s|$)")
_ITEM = re.compile(r"\s*(?:([-*+•‣])|(\d{1,4})[.)])\s+\S")
_EXTENSION = re.compile(r"[a-z]{1,5}(?![a-z/.\d])")
_WORD = re.compile(r"[^\W_]+(?:[.'’-][^\W_]+)*")
_NOTED = re.compile("[\"“”«»„「」『』（）()\\[\\]【】《》〈〉]")
_PAIRS = {"）": "（", ")": "(", "]": "[", "】": "【", "」": "「", "』": "『", "»": "«", "”": "“", "》": "《", "〉": "〈"}


@dataclass
class Cut:
    """A place in a block where a sentence may end: the positions after it and of the next letter, and what stands around."""

    end: int
    start: int
    mark: str  # '.', '!', '~' (an ellipsis), '。' or ' '
    close: str
    open: str
    shape: str  # of what follows: 'u', 'l', '9' or '-'
    closed: bool  # quotation marks or brackets close right before
    bracket: int  # where the bracket that closes here opens, or -1
    state: tuple  # the quotation marks and brackets that stay open


def blocks_of(content: str) -> Iterator[tuple[int, str, str]]:
    """Position, kind (heading, item, data or text) and text of each block, without outer white space."""
    lines, fence, at = [], False, 0
    now: list = []  # kind, first and last position of the block that is open
    number, blank = None, True

    def close() -> Iterator[tuple[int, str, str]]:
        if now:
            kind, low, high = now
            raw = content[low:high]
            text = raw.strip()
            if text:
                if kind == "text" and len(text) >= 40 and text.isascii() and not re.search(r"\S[ \t]+\S", text) and max(map(len, text.split())) >= 40:
                    kind = "data"
                yield low + len(raw) - len(raw.lstrip()), kind, text
            now.clear()

    for found in _LINE.finditer(content):
        line, low, high = found[0], found.start(), found.end()
        if low == high:
            continue
        bare = line.strip()
        if bare.startswith(("```", "~~~")):
            yield from close()
            fence, blank, number = not fence, True, None
        elif fence:
            continue
        elif not bare:
            yield from close()
            blank, number = True, None
        elif _HEADING.match(line):
            yield from close()
            yield low + len(line) - len(line.lstrip()), "heading", bare
            blank, number = True, None
        else:
            item = _ITEM.match(line)
            follows = item and (blank or bool(now) and now[0] == "item" and (item[1] or number is None or int(item[2]) == number + 1))
            if follows:
                yield from close()
                now[:] = ["item", low, high]
                number = int(item[2]) if item[2] else None
            elif now:
                now[2] = high
            else:
                now[:] = ["text", low, high]
            blank = False
    yield from close()


def blanks_end(blocks: list[tuple[int, str, str]]) -> bool:
    """Whether blanks between letters of a script without blanks stand in place of the end marks of these blocks."""
    body = " \n ".join(t for _, kind, t in blocks if kind in ("text", "item"))
    return bool(_GAP.search(body)) and not re.search(rf"[。！？｡]|[{_BLANKLESS}][.!?](?![a-z])", body)


class Script:
    """What the letters of a block are, looked at when it is asked for."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def cjk(self) -> bool:
        return not self.text.isascii() and len(_CJK.findall(self.text)) * 3 > len(self.text)

    @cached_property
    def cased(self) -> bool:
        return _mostly_cased(self.text)


@lru_cache(1)
def _caseless() -> np.ndarray:
    """Which code points are letters without case."""
    return np.array([chr(c).isalpha() and chr(c).lower() == chr(c).upper() for c in range(0x110000)])


def _mostly_cased(text: str) -> bool:
    if text.isascii():
        return True
    return int(np.count_nonzero(_caseless()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)])) * 4 < len(text)


def cuts(text: str, kind: str, blanks: bool) -> list[Cut]:
    if kind == "data":
        return []
    found = [(m.start(), m.end(), "") for m in _END.finditer(text)]
    if kind != "heading" and blanks:
        found += [(m.start(), m.start(), " ") for m in (_WIDE_GAP if _CJK.search(text) else _GAP).finditer(text)]
    if not found:
        return []
    found.sort()
    noted, next_noted = [m.start() for m in _NOTED.finditer(text)], 0
    out, open_at, quoted, stripped = [], [], False, len(text.rstrip())
    german = "„" in text
    skip = len(_ITEM.match(text)[0]) - 1 if kind == "item" and _ITEM.match(text) else 0
    script = Script(text)
    for low, high, blank in found:
        if high < skip:
            continue
        while next_noted < len(noted) and noted[next_noted] < low:
            at = noted[next_noted]
            quoted = _note(text[at], at, open_at, quoted, german)
            next_noted += 1
        end, bracket, closed = high, -1, False
        while end < len(text):
            c = text[end]
            if c == '"' and not quoted or c not in _CLOSERS and not (c == "“" and german and open_at and open_at[-1][0] == "„"):
                break
            if c in ")）]】" and open_at and open_at[-1][0] == _PAIRS[c]:
                bracket = open_at[-1][1]
            quoted = _note(c, end, open_at, quoted, german)
            closed = True
            end += 1
        while next_noted < len(noted) and noted[next_noted] < end:
            next_noted += 1
        if end >= stripped:
            continue
        cut = _cut(text, low, end, blank, closed, bracket, script)
        if cut:
            cut.state = (tuple(c for c, _ in open_at), quoted)
            out.append(cut)
    return out


def _note(c: str, at: int, open_at: list, quoted: bool, german: bool) -> bool:
    if c == '"':
        return not quoted
    if c == "“" and german and open_at and open_at[-1][0] == "„":
        open_at.pop()
    elif c in "“«„「『（([【《〈":
        open_at.append((c, at))
    elif c in _PAIRS:
        for k in range(len(open_at) - 1, -1, -1):
            if open_at[k][0] == _PAIRS[c] or c == "”" and open_at[k][0] == "„":
                del open_at[k:]
                break
    return quoted


def _cut(text: str, low: int, end: int, blank: str, closed: bool, bracket: int, script: Script) -> Cut | None:
    run, before, after = text[low:end], text[low - 1] if low else "", text[end]
    if not blank:
        if _GOES_ON.match(text, end):
            return None
        marks = _MARKS.match(run)[0]
        ellipsis = "…" in marks or "..." in run
        full = any(c in _FULL for c in marks)
        if not full and not after.isspace():
            glued = before in _NO_BLANK or before in _CLOSERS
            if after in _NO_BLANK:
                pass
            elif glued and (after.isupper() or after in _OPENERS or after.isdigit() and marks != "." or after.islower() and not _EXTENSION.match(text, end)):
                pass
            elif not (script.cjk and before.isalnum() and (after in "“「『《（" or after.isupper() and text[end + 1 : end + 2].islower())):
                return None
        mark = "~" if ellipsis else "。" if full else "." if set(marks) == {"."} else "!"
    else:
        mark = " "
    start = end
    while start < len(text) and text[start].isspace():
        start += 1
    first = start
    while first < len(text) and text[first] in _OPENERS:
        first += 1
    word = _WORD.match(text, first)
    head = text[first : first + 1]
    opening = _opening(text, first)
    lower = head.islower() and not (word and any(c.isupper() for c in word[0]))
    shape = "-" if lower and not script.cased else "l" if lower and first == start else "u" if head.isupper() or lower or first > start else "9" if head.isdigit() else "-"
    tail = text[max(0, low - 24) : low]
    closing = tail[-3:] if before in _NO_BLANK else _LAST_WORD.search(tail)[0]
    if closing.isdigit():
        closing = "9"
    return Cut(end, start, mark, closing, opening, shape, closed, bracket, ())


def _opening(text: str, first: int) -> str:
    """The word at a position: one letter of a script without blanks, 9 for any number."""
    word = _WORD.match(text, first)
    head = text[first : first + 1]
    return head if head in _NO_BLANK or not word else "9" if word[0].isdigit() else word[0]


class Habits:
    """How often words stand at a sure end or beginning, of how often they stand at a possible one."""

    def __init__(self, rows: list[tuple[str, str | None, int, int]]) -> None:
        """Rows of role, word, sure and seen; those without a word are of the role as a whole."""
        self.rate = {r: max(a, 1) / max(b, 1) for r, word, a, b in rows if word is None}
        self.by = {(r, word): (a, b) for r, word, a, b in rows if word is not None}

    def __call__(self, role: str, key: str) -> float:
        a, b = self.by.get((role, key), (0, 0))
        p = self.rate.get(role, 1.0)
        return max(-6.0, min(1.0, 1.3 * math.log((a + 3 * p) / (b + 3) / p)))


def _weights(text: str, cut: Cut, habits: Habits) -> tuple[float, float]:
    """What speaks for an end here, and for a beginning after it."""
    close = {".": 1.5, "!": 2.5, "~": 0.5, "。": 3.0, " ": 4.0}[cut.mark]
    begin = 0.0
    if cut.mark in ".!~":
        begin += {"u": 1.5, "l": -7.0, "9": 0.0, "-": 0.5}[cut.shape]
    if cut.mark == ".":
        word = cut.close.rstrip(".")
        letter = len(word) == 1 and word.isalpha() and word not in _NO_BLANK
        if word in ABBREVIATIONS or letter and not _NUMBER_BEFORE.search(text[max(0, cut.end - 8) : cut.end - len(word) - 1]):
            close -= 6
        if word == "9" and cut.open in MONTHS:
            begin -= 8
    if cut.mark in ".~" or cut.closed:
        role = cut.mark + ("q" if cut.closed else "")
        habit = habits("end" + role, cut.close)
        close += max(-1.0, habit) if cut.mark == "." and len(cut.close) >= 5 and not cut.closed else habit  # too long for an abbreviation
        begin += 0 if cut.open == "9" else habits("start", cut.open)  # numbers follow abbreviations more often than they begin
    if cut.closed and cut.open in RESUMING:
        begin -= 6
    return close, begin


_STRIDE, _FEW = 256, 24


def spans(text: str, kind: str, blanks: bool, habits: Habits) -> list[tuple[int, int]]:
    """Begin and end of each sentence of a block."""
    found = cuts(text, kind, blanks)
    whole = len(text.rstrip())
    if not found:
        return [(0, whole)] if whole else []
    weight = [_weights(text, c, habits) for c in found]
    back = _few(found, weight, whole) if len(found) < _FEW else _many(found, weight, whole)
    starts, out, j = [0, *[c.start for c in found]], [], len(found) + 1
    while j:
        out.append((starts[back[j]], whole if j > len(found) else found[j - 1].end))
        j = int(back[j])
    return out[::-1]


def _few(found: list[Cut], weight: list[tuple[float, float]], whole: int) -> list[int]:
    """As _many(), for so few ends that arrays don't pay."""
    sums, back, last = [0.0], [0], len(found)
    starts, states = [0, *[c.start for c in found]], [((), False), *[c.state for c in found]]
    for j in range(1, last + 2):
        cut = found[j - 1] if j <= last else None
        end, most, best = cut.end if cut else whole, -math.inf, 0
        for i in range(j):
            length = end - starts[i]
            score = sums[i] - (4.0 if length < 3 else 0.0)
            if length > 600:
                score -= 0.5 * math.log(length / 600)
            if cut:
                if states[i] != states[j]:
                    score -= 8.0
                if cut.bracket >= 0 and cut.bracket > starts[i] + 1:  # a bracket inside a sentence doesn't end it
                    score -= 8.0
            if score > most:
                most, best = score, i
        back.append(best)
        sums.append(most + weight[j - 1][0] + weight[j - 1][1] if cut else most)
    return back


def _many(found: list[Cut], weight: list[tuple[float, float]], whole: int) -> np.ndarray:
    """For each end, and last the block's own, the beginning of the sentence that it ends in the best choice."""
    starts = np.array([0, *[c.start for c in found]])
    begins = np.array([0.0, *[b for _, b in weight]])
    ids: dict[tuple, int] = {((), False): 0}
    states = np.array([0, *[ids.setdefault(c.state, len(ids)) for c in found]])
    back = np.zeros(len(found) + 2, np.int64)
    sums = np.full(len(found) + 2, -np.inf)  # the best score up to a beginning, with what speaks for it
    sums[0] = begins[0]
    tops = np.full(len(found) // _STRIDE + 2, -np.inf)  # the highest of these in each stretch of _STRIDE
    tops[0] = sums[0]
    for j in range(1, len(found) + 2):
        last = j > len(found)
        cut = None if last else found[j - 1]
        end = whole if last else cut.end

        def scores(low: int, high: int) -> np.ndarray:
            length = end - starts[low:high]
            score = sums[low:high] - np.where(length < 3, 4.0, 0.0) - 0.5 * np.log(np.maximum(length, 600) / 600)
            if not last:
                score = score - np.where(states[low:high] != states[j], 8.0, 0.0)
                if cut.bracket >= 0:  # a bracket inside a sentence doesn't end it
                    score = score - np.where(cut.bracket > starts[low:high] + 1, 8.0, 0.0)
            return score

        stretch = (j - 1) // _STRIDE
        low = stretch * _STRIDE
        score = scores(low, j)
        at = int(score.argmax())
        most, back[j] = score[at], low + at
        if stretch:  # no beginning in a stretch scores more than its highest sum less the penalty of the shortest length
            ends = np.arange(1, stretch + 1) * _STRIDE - 1
            bound = tops[:stretch] - 0.5 * np.log(np.maximum(end - starts[ends], 600) / 600)
            for k in np.argsort(-bound, kind="stable"):
                if bound[k] < most:
                    break
                score = scores(k * _STRIDE, (k + 1) * _STRIDE)
                at = int(score.argmax())
                if score[at] > most or score[at] == most and k * _STRIDE + at < back[j]:
                    most, back[j] = score[at], k * _STRIDE + at
        if not last:
            sums[j] = most + weight[j - 1][0] + begins[j]
            tops[j // _STRIDE] = max(tops[j // _STRIDE], sums[j])
    return back


def blocks(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, kind, blanks and block of every block."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, content in enumerate(batch.column(1).to_pylist()):
                own = list(blocks_of(content))
                blanks = blanks_end(own)
                rows += [(i, at, kind, blanks, block) for at, kind, block in own]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int32())), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.bool_()), pa.array(columns[4], pa.string())],
                names=["key", "at", "kind", "blanks", "block"],
            )

    kind = dict(documents.dtypes)[key]
    return documents.select(F.col(key).alias("key"), F.col(text).alias("content")).where(F.length("content") > 0).mapInArrow(part, f"key {kind}, at bigint, kind string, blanks boolean, block string")


def _sightings(text: str, kind: str, blanks: bool) -> Iterator[tuple[str, str, int]]:
    """Role, word and whether it is sure, for the ends and beginnings of a block."""
    found = cuts(text + " ␂", kind, blanks)  # with a mark after it, the block's own end is found as any other
    for cut in found:
        final = text[cut.end :].strip() == ""
        if cut.mark in ".~" or cut.closed:
            yield "end" + cut.mark + ("q" if cut.closed else ""), cut.close, int(final)
        if not final:
            yield "start", cut.open, 0
    head = text[_ITEM.match(text).end() - 1 :] if kind == "item" and _ITEM.match(text) else text
    if kind in ("item", "text"):
        head = head.lstrip(_OPENERS + " ")
        yield "start", _opening(head, 0), 1


def learned(parts: DataFrame, least: int) -> DataFrame:
    """role, word, sure and seen of all words seen `least` times in different blocks, and of each role as a whole (word null)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure, seen = Counter(), Counter()
        for batch in batches:
            for kind, blanks, block in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if kind == "data":
                    continue
                for role, word, final in _sightings(block, kind, blanks):
                    seen[role, word] += 1
                    sure[role, word] += final
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r for r, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string()), pa.array([sure[k] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())],
            names=["role", "word", "sure", "seen"],
        )

    # Copies of a text say nothing new.
    counted = parts.select("kind", "blanks", "block").distinct().mapInArrow(count, "role string, word string, sure bigint, seen bigint")
    summed = counted.groupBy("role", "word").agg(F.sum("sure").alias("sure"), F.sum("seen").alias("seen")).where(F.col("seen") >= least)
    return written(summed.unionByName(summed.groupBy("role").agg(F.sum("sure").alias("sure"), F.sum("seen").alias("seen")).withColumn("word", F.lit(None).cast("string"))), "habits")


def _wanted(table: pa.Table) -> pa.Table:
    """The words whose habits a group of blocks asks for."""
    keys = set()
    for kind, blanks, block in zip(*[table[c].to_pylist() for c in ("kind", "blanks", "block")]):
        for cut in cuts(block, kind, blanks):
            keys |= {("end" + cut.mark + ("q" if cut.closed else ""), cut.close), ("start", cut.open)}
    rows = sorted(keys)
    group = table["group"][0].as_py()
    return pa.table({"group": pa.array([group] * len(rows), pa.int64()), "role": pa.array([r for r, _ in rows], pa.string()), "word": pa.array([w for _, w in rows], pa.string())})


def sentences(documents: DataFrame, key: str, text: str, least: int = 5, most: int = 500_000, group_blocks: int = 20_000) -> DataFrame:
    """`key`, start_pos and end_pos of each sentence of `text`, in code points, the end exclusive, without outer white space.

    Null, blank and code-only texts give no rows; a text that comes again, or has no key, gives its rows as any other; an empty table gives
    none. Other columns are not looked at. Of a block of any length each end is compared with the beginnings of its own
    stretch and of those others that a bound doesn't rule out.

    What is learned of words seen `least` times goes to every task as long as it is of no more than `most` words; beyond,
    blocks go in groups of about `group_blocks`, and each group gets what is known of its own words by a join.
    """
    parts = written(blocks(documents, key, text), "blocks")
    known = learned(parts, least)
    schema = f"`{key}` {dict(documents.dtypes)[key]}, start_pos bigint, end_pos bigint"
    few = known.limit(most + 1).count() <= most
    roles = [tuple(r) for r in (known if few else known.where("word IS NULL")).collect()]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        habits = Habits(roles)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_chosen(batch.columns, habits), names=[key, "start_pos", "end_pos"])

    if few:
        return parts.mapInArrow(choose, schema)

    def choose_group(own: pa.Table, words: pa.Table) -> pa.Table:
        habits = Habits([*roles, *zip(*[words[c].to_pylist() for c in ("role", "word", "sure", "seen")])])
        return pa.table(_chosen([own[c].combine_chunks() for c in ("key", "at", "kind", "blanks", "block")], habits), names=[key, "start_pos", "end_pos"])

    grouped = parts.withColumn("group", F.pmod(F.xxhash64("key", "at"), F.lit(max(1, parts.count() // group_blocks))))
    asked = grouped.groupBy("group").applyInArrow(_wanted, "group bigint, role string, word string")
    told = asked.join(known, ["role", "word"])
    return grouped.groupBy("group").cogroup(told.groupBy("group")).applyInArrow(choose_group, schema)


def _chosen(columns: list[pa.Array], habits: Habits) -> list[pa.Array]:
    row, low, high = [], [], []
    for i, (at, kind, blanks, block) in enumerate(zip(*[c.to_pylist() for c in columns[1:]])):
        for a, b in spans(block, kind, blanks, habits):
            row.append(i)
            low.append(at + a)
            high.append(at + b)
    return [columns[0].take(pa.array(row, pa.int32())), pa.array(low, pa.int64()), pa.array(high, pa.int64())]
