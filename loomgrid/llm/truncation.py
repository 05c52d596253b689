"""Text cut off by field limits.

Three kinds of evidence, in this order:

1. Near-copies.  A cut copy is near to a beginning of its source.  The last
   characters (TAILS) of each value that is not closed for good (of one with a mark at the
   cut: before the mark) are looked for at every position of every text; what stands
   before such a position is a beginning.  Values and beginnings meet where they
   share a min-hash band of their five-word shingles, and met pairs are aligned:
   where at least SIMILAR of the shingles agree up to there and the longer goes on in
   the middle of a word or line, the shorter was cut.
2. The kind of ending of what found no copy: a mark left at the cut is evidence by
   itself; any other kind (open fence, bracket, string or code span, a path without
   its ending, a sentence without its stop, ...) is scored by how much more often it
   occurs where texts are cut at random than where they end, over all texts.
3. Terminality of the closing word, where the kind of ending tells nothing.  Over all
   lines of all texts it is counted how often a word occurs in lines of a kind (list
   items, comments, statements by their first word) and how often it closes them;
   equal texts count once.  A text whose closing word hardly ever closes such a line
   was cut, and so was one whose closing word only ever closes and begins a much more
   frequent word.
"""

from __future__ import annotations

import itertools
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgrid.llm.spans import _codes, gram_hashes
from loomgrid.workspace import Workspace

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 6, 3
#: (characters at the end of a value that its source must hold, least length of such values), the longest first.
#: A longer tail says more, and an edit within it hides the source; phrases that many texts share are shorter than the first.
TAILS = ((64, 128), (24, 24), (8, 8))
#: Slack of the place where a value may end in its source.
TAIL = 24
#: The end in the source lies in one of the length classes that a text's own length allows; a class spans this ratio.
CLASS_RATIO = 1.25
#: Bits of the bitmap of the keys that are looked for, at most; beyond, more texts are carried on and none is lost.
MOST_BITS = 30
#: Texts of a key that one task aligns with each other; larger groups are cut into cells, and every pair of cells meets.
CELL = 500
#: A word that stands in at least this many lines of a kind is no terminal one when it closes less than this share of them.
CLOSES_SHARE, CLOSES_LEAST = 0.2, 3
#: A word that only ever closes lines of a kind is a piece of a longer one that is seen there at least 1 / PIECE_SHARE times as often.
PIECE_SHARE = 2 / 3
#: Texts, about, that are cut at random to fit the odds of the kinds of ending; chosen by their hash. All texts count as they end.
FIT_ROWS = 20_000
#: Weight of what ``judge`` says about a kind of ending against what is counted, in texts.
PRIOR = 50
#: Log odds from which a kind of ending is cut, and from which one that ``judge`` leaves open is.
CUT_ODDS, ASK_ODDS = 1.0, 3.0
#: A class of closing words (numbers, identifiers) is terminal when it closes this share of the lines of a kind.
CLASS_SHARE = 0.05

# Marks that programs leave where they cut, and file endings of paths.
_MARK = re.compile(r"(?i)(?:…|\.\.\.|[\[(<{]\s*(?:\.\.\.|…)?\s*(?:truncated|cut(?: off)?|snip(?:ped)?|trimmed|clipped|omitted|more|continued|cont\.?)\b[^\])>}\n]{0,40}[\])>}]|<!--\s*truncated\s*-->|\b\d+ more (?:characters|chars|bytes|lines)\W*)\s*$")
_EXT = "rs|go|py|pyi|ts|tsx|js|jsx|mjs|cjs|c|h|cc|cpp|hpp|cs|java|kt|kts|rb|php|swift|scala|lua|zig|dart|sh|sql|md|rst|txt|json|yaml|yml|toml|lock|cfg|ini|xml|html|css|scss|proto|svelte|vue|gradle|mod|sum|ipynb|csv"
_PATH_END = re.compile(rf"(?:^|[\s`(])[\w@.~-]*(?:/[\w@.~-]+)+$|(?:^|\s)[\w-]+\.(?:{_EXT})$")
_PATH_WHOLE = re.compile(rf"\.(?:{_EXT})(?::\d+)*$")
#: Words after the label of a reference line, at most; more are a sentence.
REF_WORDS = 6
#: Characters at the end of a text in which a mark lies.
MARK_CHARS = 200
_FENCE = re.compile(r"(?m)^\s*```")
_NEW_SENTENCE = re.compile(r"[a-z]\. [A-Z`]")
_PATCH_CODE = re.compile(r"[-+]\s*(?:\w+\s*[=:({]|const |let |var |export |fn |def |if |func |pub |return )")
_OPEN_END = re.compile(r"(?:[+*/|&<,(\[{\\.-]|->|=>|\b(?:and|or|not|in|is|return await))$")
_BLOCK_HEAD = re.compile(r"\s*(?:def|class|if|for|while|else|elif|try|except|with)\b")
_STOP_INSIDE = re.compile(r"[a-z`)\w][.!?][\"'`)]*(?:\s+[A-Z`\"(]|\n)")
_LIST = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+(?=\S)")
_REF = re.compile(r"^(?:[A-Z][\w-]*(?: [a-z]+)?): \S")
_COMMENT = re.compile(r"^\s*(?://|#(?!!)|--|/\*|\*\s|;;)")
_PATCH = re.compile(r"^(?:[-+](?![-+]\s*$)|@@|diff |index |--- |\+\+\+ | )")
_CODE_START = re.compile(
    r"^\s*(?:def |async |class |fn |func |function |pub |export |import |from \S+ import|return\b|let |const |var |if \(?.*[:{]|if [^.]*$|for .*[:{(]|for |while |match |assert |self\.|this\.|@\w|else|elif |try|except|raise |throw |use |package |struct |enum |interface |type |\}|\{|</?\w|set [A-Z_]+=|[A-Z_]{3,}=|[\w.]+\[[^\]]*\] = |[\w, ]+ :?= |[\w.]+(?:: [\w\[\]<>, ]+)? = |[\w.:]+\(.*)"
)
_WORD = re.compile(r"\w+")
#: A finished setting: a name and one bare value or number.
_SETTING = re.compile(r"^[-+\s]*+(?:export |set |let |var |const )?[\w.-]++\s*+[:=]\s*+(?:(?=\D*\d)[\w./+@%-]++)?$")


_OPAQUE = re.compile(r"""//[^\n]*|(?:(?<=\s)|^)\#[^\n]*|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*'""", re.M)
_NOT_BRACKET = re.compile(r"[^()\[\]{}]+")


def _brackets(text: str) -> tuple[str, str]:
    """(open brackets, open string quote) at the end of code; comments and closed strings are skipped."""
    bare = _OPAQUE.sub("", text)
    end = bare[bare.rfind("\n") + 1 :]
    quote = '"' if '"' in end else "`" if "`" in bare else ""
    stack: list[str] = []
    for c in _NOT_BRACKET.sub("", bare):
        if c in "([{":
            stack.append(c)
        elif stack and stack[-1] == {")": "(", "]": "[", "}": "{"}[c]:
            stack.pop()
    return "".join(stack), quote


def line_kind(line: str) -> str:
    """The kind of line under which closing words are counted."""
    if _LIST.match(line):
        return "list"
    if _COMMENT.match(line):
        return "comment"
    if _CODE_START.match(line):
        w = re.match(r"\s*(\w+)", line)
        if re.search(r"(?<![=!<>])=(?!=)", line):
            return "code:="
        return "code:" + (w[1] if w and len(w[1]) < 9 else "")
    return "prose"


def word_class(w: str) -> str:
    """A closing word, or the class of it: identifiers, numbers and mixtures have no identity of their own."""
    if re.fullmatch(r"\d[\d.,_]*", w):
        return "<num>"
    if "_" in w or re.search(r"[a-z][A-Z]", w):
        return "<ident>"
    if re.search(r"\d", w) and not re.fullmatch(r"[A-Za-z]{1,10}\d{1,2}", w):
        return "<mixed>"
    return w.lower()


def last_word(line: str) -> str:
    s = line.rstrip()
    i = len(s)
    while i and (s[i - 1].isalnum() or s[i - 1] == "_"):
        i -= 1
    return s[i:]


def closes_sentence(line: str) -> bool:
    """Whether a line ends in a stop, whatever quotes and brackets close after it."""
    s = line.rstrip("\"'`)]*_")
    return bool(s) and s[-1] in ".!?:;"


def closes_for_good(text: str) -> bool:
    """Whether a text ends in a mark that closes it; one that ends otherwise may still be the beginning of a longer copy."""
    s = text.rstrip().rstrip("*_")
    return bool(s) and s[-1] in ".!?:;)]}>\"'`"


def is_reference(line: str) -> bool:
    """Whether a line is a label and a few words, such as an issue number or a name."""
    return bool(_REF.match(line)) and line.count(" ") <= REF_WORDS


def _ends_in_word(s: str) -> bool:
    return s[-1:].isalnum() or s[-1:] == "_"


def judge(text: str) -> tuple[str, str, str, str]:
    """(verdict, reason, kind of the last line, closing word); verdict is cut, whole or ask."""
    t = text.rstrip()
    if not t:
        return "whole", "empty", "", ""
    if _MARK.search(t[-MARK_CHARS:]):
        return "cut", "mark", "", ""
    fences = len(_FENCE.findall(t)) if "```" in t else 0
    lines = t.split("\n")
    last = lines[-1]
    if fences % 2:
        return "cut", "open_fence", "", ""
    if fences and last.strip() == "```":
        return "whole", "closed_fence", "", ""
    body = lines
    if fences:
        end = max(i for i, x in enumerate(lines) if x.lstrip().startswith("```"))
        body = lines[end + 1 :]
    first = next((x for x in body if x.strip()), "")
    patch = len(lines) > 1 and all(_PATCH.match(x) for x in lines) and any(x.startswith("+") for x in lines) or bool(first[:1] in ("-", "+") and _PATCH_CODE.match(first))
    if not fences and _SETTING.match(last):
        return "whole", "setting", "", ""
    if patch:
        stack, quote = _brackets(last[1:])
        if quote or stack.strip("{"):
            return "cut", "open_code", "", ""
        return ("ask", "patch_word", line_kind(last[1:]), last_word(last)) if _ends_in_word(last) else ("whole", "patch", "", "")
    code_last, code_first, comment = bool(_CODE_START.match(last)), bool(_CODE_START.match(first)), bool(_COMMENT.match(last))
    sentences = bool(_NEW_SENTENCE.search(last))
    code = (code_last or comment) and not sentences or bool(code_first and last[:2].isspace() and last[:2].strip() == "" and len(last) > 2 and last.startswith(("  ", "\t"))) or code_first and not fences and len(lines) > 1 and not sentences
    if code and not _LIST.match(last):
        stack, quote = _brackets("\n".join(body))
        if quote or stack:
            return "cut", "open_code", "", ""
        if not comment and _OPEN_END.search(last[-20:]):
            return "cut", "open_statement", "", ""
        if last.endswith(":") and _BLOCK_HEAD.match(last):
            return "cut", "open_block", "", ""
        return ("ask", "code_word", line_kind(last), last_word(last)) if _ends_in_word(last) else ("whole", "code", "", "")
    if last.count("`") % 2:
        return "cut", "open_span", "", ""
    token = last.split()[-1]
    path = bool(_PATH_END.search(token))
    if path and _PATH_WHOLE.search(token):
        return "whole", "reference", "", ""
    if closes_sentence(last):
        return "whole", "stop", "", ""
    if last.count("(") > last.count(")") or last.count('"') % 2:
        return "cut", "open_bracket", "", ""
    if path and token != last.strip():
        return "cut", "open_path", "", ""
    if _LIST.match(last):
        return ("ask", "list_word", "list", last_word(last)) if _ends_in_word(last) else ("whole", "list", "", "")
    if is_reference(last):
        v = last.split(": ", 1)[1]
        shape = re.sub(r"\d+", "0", re.sub(r"[A-Za-z]+", "a", v))
        return "ask", "ref_word", "ref:" + last.split(":")[0], shape
    if len(last.split()) > 12 or _STOP_INSIDE.search(t):
        return "cut", "open_sentence", "", ""
    return ("ask", "word", "prose", last_word(last)) if _ends_in_word(last) else ("whole", "other", "", "")


def closings(text: str, out: dict) -> None:
    """Add (kind, word) -> [occurrences, closings] and (kind, '') -> [lines, 0] of a text's lines to ``out``.

    Only lines that close with a word or are as short as lists and comments are
    looked into; sentences are judged by their stops.
    """

    def add(kind: str, word: str, closes: bool) -> None:
        e = out.get((kind, word))
        if e is None:
            e = out[kind, word] = [0, 0]
        e[0] += 1
        e[1] += closes

    for line in text.rstrip().split("\n"):
        if not line or line.isspace() or line.lstrip().startswith("```"):
            continue
        if is_reference(line):
            k, v = line.split(":")[0], line.split(": ", 1)[1]
            add("ref:" + k, re.sub(r"\d+", "0", re.sub(r"[A-Za-z]+", "a", v)), True)
            add("ref:" + k, "", False)
        x = line[1:] if line[0] in "+-" and _PATCH.match(line) and not _LIST.match(line) else line
        kind = line_kind(x)
        if kind == "prose" and x.count(" ") > 11:
            continue
        add(kind, "", False)
        close = word_class(w) if (w := last_word(x)) else None
        if kind.startswith("code") and close is None:
            continue
        for w in {word_class(w) for w in _WORD.findall(x)}:
            add(kind, w, w == close)


def learn(text: str, th: int, reason: str, share: float, out: dict) -> None:
    """Count a text for the statistics: its closing words, its kind of ending, and for a share of the texts that of the same text cut at a place chosen by its hash."""
    closings(text, out)
    out.setdefault(("~end", reason), [0, 0])[0] += 1
    n = len(text)
    if n >= 20 and (th >> 33 & 0x3FFFFFFF) < share * (1 << 30):
        p = n // 5 + (th & 0x7FFFFFFF) % (n - n // 5)
        out.setdefault(("~cut", judge(text[:p])[1]), [0, 0])[0] += 1


def ending_odds(counts: dict[tuple[str, str], int], verdicts: dict[str, str]) -> dict[str, float]:
    """Log odds of each kind of ending being a cut one, from its counts at cuts and at ends; PRIOR texts say what ``judge`` says."""
    prior = {"cut": (0.1, 0.01), "whole": (0.01, 0.1), "ask": (0.03, 0.03)}
    total = {k: sum(n for (kind, _), n in counts.items() if kind == k) for k in ("~cut", "~end")}

    def rate(kind: str, reason: str, q: float) -> float:
        return (counts.get((kind, reason), 0) + PRIOR * q) / (total[kind] + PRIOR)

    return {r: math.log(rate("~cut", r, prior[v][0]) / rate("~end", r, prior[v][1])) for r, v in verdicts.items()}


#: Every kind of ending that ``judge`` tells apart, with its own verdict.
ENDINGS = {
    **dict.fromkeys(("mark", "open_fence", "open_code", "open_statement", "open_block", "open_span", "open_bracket", "open_path", "open_sentence"), "cut"),
    **dict.fromkeys(("closed_fence", "setting", "patch", "code", "reference", "stop", "list", "other"), "whole"),
    **dict.fromkeys(("patch_word", "code_word", "list_word", "ref_word", "word"), "ask"),
}


_SEEDS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) for i in range(BANDS * ROWS)], np.uint64)


_cache: dict[str, int] = {}


def _word_hashes(text: str) -> list[int]:
    c, out = _cache, []
    if len(c) > 500_000:
        c.clear()
    for w in _WORD.findall(text.lower()):
        h = c.get(w)
        if h is None:
            h = c[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return out


def _shingle_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, rows) of all texts, in order; texts shorter than a shingle have none."""
    lists = [_word_hashes(t) for t in texts]
    h = np.array([x for v in lists for x in v], np.uint64)
    row = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
    n = len(h) - SHINGLE + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        s = np.zeros(n, np.uint64)
        for j in range(SHINGLE):
            s = s * np.uint64(0x100000001B3) + h[j : j + n]
        s ^= s >> np.uint64(29)
    inside = row[:n] == row[SHINGLE - 1 :]
    return s[inside], row[:n][inside]


def _shingles(text: str) -> np.ndarray:
    return _shingle_rows([text])[0]


def bands(texts: list[str]) -> pa.Array:
    """Signed 64-bit keys of each text's min-hash bands; an empty list for texts shorter than a shingle."""
    s, row = _shingle_rows(texts)
    rows, start = np.unique(row, return_index=True)
    keys = np.zeros((len(rows), BANDS), np.uint64)
    if len(rows):
        with np.errstate(over="ignore"):
            for i in range(BANDS):
                k = np.full(len(rows), i, np.uint64)
                for seed in _SEEDS[i * ROWS : (i + 1) * ROWS]:
                    k = (k ^ np.minimum.reduceat((s ^ seed) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1), start)) * np.uint64(0x94D049BB133111EB)
                    k ^= k >> np.uint64(31)
                keys[:, i] = k
    size = np.zeros(len(texts), np.int64)
    size[rows] = BANDS
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))


def _goes_on(rest: str) -> bool:
    """Whether what follows a cut position continues the word or line."""
    return bool(rest.strip()) and rest[0] not in "\r\n" and not (re.match(r"[.!?;,)`'\"]", rest) and not rest[1:].strip())


def ends_early(short: str, long: str) -> bool:
    """Whether ``short`` is a near-copy of the beginning of ``long`` that stops inside a word or line of it."""
    a, b = short.rstrip(), long.rstrip()
    tail, (lo, hi) = a[-TAIL:], _range(len(a))
    ends, at = [], b.find(tail, max(0, lo - len(tail)), hi)
    while at >= 0:
        if _goes_on(b[at + len(tail) :]):
            ends.append(at + len(tail))
        at = b.find(tail, at + 1, hi)
    return Beginnings(b, ends).hold(a, _shingle_set(a)) if ends else False


def _range(n: int) -> tuple[int, int]:
    """Smallest and largest end in the source of a text of n characters."""
    return n - n // 5, n + n // 5 + TAIL


def _shingle_set(text: str) -> set[int]:
    return set(_shingles(text).tolist())


class Beginnings:
    """A text up to some of its positions, of which one may be the end of a near-copy."""

    def __init__(self, text: str, ends: list[int]):
        self.text, self.ends = text, sorted(ends)
        self._words: list[tuple[int, int]] | None = None

    def _prepare(self) -> None:
        self._words = [m.span() for m in _WORD.finditer(self.text)]
        self._stops = [e for _, e in self._words]
        self._shingles = _shingles(self.text).tolist()

    def hold(self, a: str, x: set[int]) -> bool:
        """Whether ``a`` with shingles ``x`` is a near-copy of the text up to one of the positions."""
        lo, hi = _range(len(a))
        ends = [e for e in self.ends[bisect_left(self.ends, lo) : bisect_right(self.ends, hi)] if self.text.endswith(a[-TAIL:], 0, e)]
        if not ends or not x or closes_sentence(a):
            return False
        if self._words is None:
            self._prepare()
        # Shingles come in one by one as the end moves on; only that of a word cut by the end is made anew.
        seen: set[int] = set()
        both = at = 0
        for e in ends:
            w = bisect_right(self._stops, e)
            while at < w - SHINGLE + 1:
                s = self._shingles[at]
                if s not in seen:
                    seen.add(s)
                    both += s in x
                at += 1
            size, common = len(seen), both
            if w < len(self._words) and self._words[w][0] < e and w >= SHINGLE - 1:
                s = int(_shingles(self.text[self._words[w - SHINGLE + 1][0] : e])[-1])
                if s not in seen:
                    size += 1
                    common += s in x
            if common >= SIMILAR * (len(x) + size - common) and size:
                return True
        return False


def shingle_sets(texts: list[str]) -> list[set[int]]:
    s, row = _shingle_rows(texts) if texts else (np.empty(0, np.uint64), np.empty(0, np.int64))
    at = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    s = s.tolist()
    return [set(s[i:j]) for i, j in itertools.pairwise(at)]


def _rare(x: set[int]) -> list[int]:
    """The smallest shingles, of which two sets share one if at least SIMILAR of their shingles agree."""
    return sorted(x)[: len(x) - int(SIMILAR * len(x)) + 1]


class Group:
    """Beginnings that end in the same characters, found by a shingle that every near-copy must share."""

    def __init__(self):
        self.by: dict[int, list[tuple[str, set[int]]]] = {}

    def add(self, text: str, y: set[int]) -> None:
        for s in _rare(y):
            self.by.setdefault(s, []).append((text, y))

    def hold(self, a: str, x: set[int]) -> bool:
        if not x or closes_sentence(a):
            return False
        (lo, hi), tail = _range(len(a)), a[-TAIL:]
        for s in _rare(x):
            for b, y in self.by.get(s, ()):
                if lo <= len(b) <= hi and SIMILAR * len(x) <= len(y) and SIMILAR * len(y) <= len(x) and b.endswith(tail) and len(x & y) >= SIMILAR * len(x | y):
                    return True
        return False


_KEY_SALT = np.uint64(0xD6E8FEB86659FD93)


def _classes(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(CLASS_RATIO)).astype(np.uint64)


def _keyed(h: np.ndarray, k: int, cls: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ (cls + np.uint64(1000 * k))) * _KEY_SALT
        x ^= x >> np.uint64(32)
        return x * np.uint64(0x9E3779B97F4A7C15) ^ x


def tail_keys(text: str) -> list[int]:
    """Signed keys of a text's last characters: one for the characters alone, then one for each length class that the end in its source may have."""
    a = text.rstrip()
    k = next((k for k, least in TAILS if len(a) >= least), 0)
    if not k:
        return []
    lo, hi = _classes(np.array(_range(len(a)))).tolist()
    h = gram_hashes(_codes(a[-k:]), k)
    return _keyed(np.repeat(h, hi - lo + 2), k, np.array([0, *range(lo, hi + 1)], np.uint64)).view(np.int64).tolist()


def _bits(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three positions of each key among ``bits`` (a power of two), independent of each other."""
    mask = np.uint64(bits - 1)
    with np.errstate(over="ignore"):
        return [keys & mask, keys * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(31) & mask, keys * np.uint64(0x94D049BB133111EB) >> np.uint64(29) & mask]


def _probe(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of the keys whose bits are all set."""
    at = np.arange(len(keys))
    for k in range(3):
        bit = _bits(keys[at], len(bitmap) * 8)[k]
        at = at[(bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return at


def band_keys(tails: np.ndarray, bands_: np.ndarray) -> np.ndarray:
    """Signed keys under which a value and a beginning meet: the same last characters and length class, and the same min-hash band."""
    with np.errstate(over="ignore"):
        x = (tails[..., None].view(np.uint64) * _KEY_SALT) ^ bands_.view(np.uint64)
        x ^= x >> np.uint64(31)
        return (x * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _band_matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the texts that have shingles, their bands)"""
    lists = bands(texts)
    n = np.diff(lists.offsets.to_numpy())
    return np.flatnonzero(n), lists.values.to_numpy().reshape(-1, BANDS)


def beginnings(texts: list[str], bitmap: np.ndarray) -> list[tuple[int, str]]:
    """(key, text up to the place) of each place where a text holds a key of the bitmap and goes on."""
    out: list[tuple[int, str]] = []
    texts = [t.rstrip() for t in texts]
    class_of = _classes(np.arange(max(map(len, texts), default=0) + 1))
    longest = math.inf
    for k, least in TAILS:
        # Values of this level are shorter than those of the one before, and so end early in their source.
        far, longest = (_range(longest)[1] if longest < math.inf else 0), least
        parts = [t[: far + 2] for t in texts] if far else texts
        size = np.array([len(t) for t in parts])
        stop = np.cumsum(size)
        start = stop - size
        codes = _codes("".join(parts))
        h = gram_hashes(codes, k)
        if not len(h):
            continue
        # By the characters alone first; what is left is so little that the rest costs nothing.
        at = _probe(bitmap, _keyed(h, k, np.uint64(0)))
        row, end = np.searchsorted(stop, at, "right"), at + k
        ok = end < stop[row]
        row, end, at = row[ok], end[ok], at[ok]
        nxt = codes[end]
        ok = (nxt != 10) & (nxt != 13) & ~((end + 1 == stop[row]) & np.isin(nxt, np.frombuffer(".!?;,)`'\"".encode("utf-32-le"), np.uint32)))
        if far:
            ok &= end - start[row] <= far
        row, end, at = row[ok], end[ok], at[ok]
        keys = _keyed(h[at], k, class_of[end - start[row]])
        for i in _probe(bitmap, keys).tolist():
            out.append((int(keys[i : i + 1].view(np.int64)[0]), texts[row[i]][: int(end[i] - start[row[i]])]))
    return out


def _bitmap(keys: DataFrame, n: int) -> np.ndarray:
    """Bits of the keys, built in slices so that no task and no result holds the whole."""
    bits = 1 << min(MOST_BITS, max(20, (64 * n).bit_length()))
    size = 1 << 20

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.unique(np.concatenate(_bits(b.column(0).to_numpy().view(np.uint64), bits)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x >> 20), pa.array(x & (size - 1))], names=["slice", "bit"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            s, bit = (c.to_numpy() for c in b.columns)
            for x in np.unique(s).tolist():
                own.setdefault(x, np.zeros(size, bool))[bit[s == x]] = True
        for x, v in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()), pa.array([np.packbits(v, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    parts = keys.select("key").mapInArrow(places, "slice long, bit long").distinct().repartition("slice")
    out = np.zeros(bits // 8, np.uint8)
    for s, v in parts.mapInArrow(slices, "slice long, bits binary").collect():
        out[s * size // 8 : (s + 1) * size // 8] = np.frombuffer(v, np.uint8)
    return out


def near_copies(asks: DataFrame, texts: DataFrame, ws: Workspace) -> DataFrame:
    """(th) of the texts of ``asks`` (th, tails, text) that are cut near-copies of beginnings of ``texts`` (text).

    Keys alone are shuffled first; only values and beginnings under a key that both
    have carry their texts on.
    """
    spark = asks.sparkSession
    keyed = asks.select("th", F.explode("tails").alias("key"))
    held = spark.sparkContext.broadcast(_bitmap(keyed, keyed.count()))

    def rows(keys: list[np.ndarray], cols: list[pa.Array], names: list[str]) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        flat = np.concatenate([np.empty(0, np.int64), *keys])
        return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, size = [], 0
            for t in [*b.column(0).to_pylist(), None]:
                if part and (t is None or size > 500_000):
                    got = beginnings(part, held.value)
                    at, m = _band_matrix([x for _, x in got]) if got else ((), None)
                    if len(at):
                        keys = band_keys(np.array([got[i][0] for i in at.tolist()], np.int64), m)
                        yield rows(list(keys), [pa.array([got[i][1] for i in at.tolist()], pa.string())], ["text", "keys"])
                    part, size = [], 0
                if t is not None:
                    part.append(t)
                    size += len(t)

    def keyed_asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            th, tails, text = (c.to_pylist() for c in b.columns)
            at, m = _band_matrix([x.rstrip() for x in text]) if text else ((), None)
            keys = [np.concatenate([band_keys(np.array([k], np.int64), m[j : j + 1]).ravel() for k in tails[i][1:]] or [np.empty(0, np.int64)]) for j, i in enumerate(at)]
            yield rows(keys, [pa.array([th[i] for i in at], pa.int64())], ["th", "keys"])

    found = ws.write(texts.select("text").mapInArrow(find, "text string, keys array<long>").select(F.xxhash64("text").alias("th"), "text", "keys"), "beginnings")
    a = ws.write(asks.select("th", "tails", "text").mapInArrow(keyed_asks, "th long, keys array<long>").select("th", F.explode("keys").alias("key")).distinct(), "value_keys")
    b = ws.write(found.select("th", F.explode("keys").alias("key")).distinct(), "beginning_keys")
    both = ws.write(a.groupBy("key").agg(F.count("*").alias("na")).join(b.groupBy("key").agg(F.count("*").alias("nb")), "key"), "met")
    # A group larger than CELL is cut into cells on both sides. First every cell of values meets one cell of
    # beginnings; in a large group nearly all find their copy there. Only what found none meets the other cells.
    ca, cb = F.ceil(F.col("na") / CELL).cast("int"), F.ceil(F.col("nb") / CELL).cast("int")
    a = a.join(both, "key").select("key", "th", cb.alias("cb"), F.pmod("th", ca).cast("int").alias("p"))
    b = b.join(both, "key").select("key", "th", ca.alias("ca"), cb.alias("cb"), F.pmod("th", cb).cast("int").alias("q"))
    only = lambda texts_, keys: texts_.select("th", "text").join(keys.select("th").distinct(), "th", "left_semi").dropDuplicates(["th"])
    left = a.join(only(asks, a), "th")
    right = b.join(only(found, b), "th")
    one = F.when(F.col("q") < F.col("ca"), F.sequence(F.col("q"), F.col("ca") - 1, F.col("cb"))).otherwise(F.array().cast("array<int>"))
    first_a = left.select("key", "p", F.lit(0).alias("q"), F.lit(1).alias("side"), "th", "text")
    first_b = right.select("key", F.explode(one).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side"), "th", "text")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, Group()
        for batch in batches:
            key, p, q, side, th, text = (c.to_pylist() for c in batch.columns)
            text, hit = [t.rstrip() if s else t for t, s in zip(text, side, strict=True)], []
            for *at, s, h, t, x in zip(key, p, q, side, th, text, shingle_sets(text), strict=True):
                if at != now:
                    now, group = at, Group()
                if s == 0:
                    group.add(t, x)
                elif group.hold(t, x):
                    hit.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64())], names=["th"])

    def aligned(x: DataFrame, y: DataFrame) -> DataFrame:
        met = x.unionByName(y).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "side")
        return met.mapInArrow(align, "th long").distinct()

    hit = ws.write(aligned(first_a, first_b), "hits")
    rest = left.where("cb > 1").join(hit, "th", "left_anti")
    cells = F.filter(F.sequence(F.lit(0), F.col("cb") - 1), lambda q: q != F.pmod("p", "cb"))
    rest = ws.write(rest.select("key", "p", F.explode(cells).alias("q"), F.lit(1).alias("side"), "th", "text"), "unmet")
    asked = rest.select("key", "p", "q").distinct()
    other = right.where("cb > 1").join(asked, ["key", "q"]).select("key", "p", "q", F.lit(0).alias("side"), "th", "text")
    return hit.unionByName(aligned(rest, other)).distinct()


def text_values(df: DataFrame, table: str, id_col: str, fields: list[str], source: str | None = None) -> DataFrame:
    """(table_name, row_id, field, source, text) of the non-blank values."""
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]))
    src = (F.col(source) if source else F.lit(None)).cast("string").alias("source")
    out = df.select(F.lit(table).alias("table_name"), F.col(id_col).cast("long").alias("row_id"), src, parts.alias("_v"))
    return out.select("table_name", "row_id", "_v.field", "source", "_v.text").where("text is not null and text rlike '[^\\\\s]'")


def cut_values(values: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(table_name, row_id, field, reason) of the values that were cut, each once.

    Null and blank values are whole.  Values stored twice under one id come out
    once.  Whole texts are judged, of any length.
    """
    spark = values.sparkSession
    ws = ws or Workspace(spark, "truncation")
    keys = ["table_name", "row_id", "field"]
    cols = values.select(*keys, "text")

    # Lines of equal texts count once: texts that may be stored again are carried on and made distinct.
    seen_ = Observation()
    again = cols.select(F.xxhash64("text").alias("key")).groupBy("key").count().observe(seen_, F.sum("count").alias("n"))
    again, n_again = ws.write_measured(again.where("count > 1").select("key"), "again", F.count(F.lit(1)))
    share = FIT_ROWS / max(1, seen_.get["n"] or 0)
    repeated = spark.sparkContext.broadcast(_bitmap(again, n_again))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats: dict = {}
        names = ["tag", "table_name", "row_id", "field", "verdict", "reason", "kind", "word", "n", "m", "th", "tails", "text"]
        types = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
        for b in batches:
            rows, ths = [], b.column(4).to_numpy().view(np.uint64)
            dup = {x: None for x in ths[_probe(repeated.value, ths)].view(np.int64).tolist()}
            for tb, i, f, t, th in zip(*(c.to_pylist() for c in b.columns), strict=True):
                v, r, k, w = judge(t)
                if th not in dup:
                    learn(t, th, r, share, stats)
                elif dup[th] is None:
                    dup[th] = t
                if v == "whole" and r == "empty":
                    continue
                open_ = _MARK.sub("", t.rstrip()) if r == "mark" else t
                tails = tail_keys(open_) if v != "whole" or not closes_for_good(t) else []
                rows.append((0, tb, i, f, v, r, k, word_class(w) if not k.startswith("ref:") else w, 0, 0, th, tails, open_ if tails else None))
            rows += [(2, "", 0, "", "", "", "", "", 0, 0, th, None, t) for th, t in dup.items() if t is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            if len(stats) > 200_000:
                yield flush(stats, names, types)
        if stats:
            yield flush(stats, names, types)

    def flush(stats: dict, names: list[str], types: list) -> pa.RecordBatch:
        rows = [(1, "", 0, "", "", "", k, w, n, m, None, None, None) for (k, w), (n, m) in stats.items()]
        stats.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "tag int, table_name string, row_id long, field string, verdict string, reason string, kind string, word string, n long, m long, th long, tails array<long>, text string"
    judged = ws.write(cols.withColumn("th", F.xxhash64("text")).mapInArrow(first, schema), "judged")
    vals = judged.where("tag = 0")

    asked = vals.where("size(tails) > 0")
    copies = asked.join(near_copies(asked, cols, ws), "th").select(*keys, F.lit(0).alias("rank"), F.lit("copy_goes_on").alias("reason"))

    # Terminality of the closing words still in question. A word that only ever closes says nothing by
    # its share; it counts as cut where it begins a word that is more frequent in such lines.
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats: dict = {}
        for b in batches:
            for th, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                learn(t, th, judge(t)[1], share, stats)
            if len(stats) > 200_000:
                yield lines_of(stats)
        if stats:
            yield lines_of(stats)

    def lines_of(stats: dict) -> pa.RecordBatch:
        rows = [(k, w, n, m) for (k, w), (n, m) in stats.items()]
        stats.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["kind", "word", "n", "m"])

    once = judged.where("tag = 2").dropDuplicates(["th"]).select("th", "text").mapInArrow(count, "kind string, word string, n long, m long")
    st = judged.where("tag = 1").select("kind", "word", "n", "m").unionByName(once).groupBy("kind", "word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    st = ws.write(st, "words")

    # Kinds of ending by their odds; their number is fixed, see ENDINGS.
    counts = {(r.kind, r.word): r.n for r in st.where("kind in ('~end', '~cut')").select("kind", "word", "n").collect()}
    odds = ending_odds(counts, ENDINGS)
    cut = ["mark", *(r for r, v in ENDINGS.items() if odds[r] > (ASK_ODDS if v == "ask" else CUT_ODDS) and r != "mark")]
    sure = vals.where(F.col("reason").isin(cut)).select(*keys, F.lit(1).alias("rank"), "reason")
    ask = vals.where((F.col("verdict") == "ask") & ~F.col("reason").isin(cut))

    lines = st.where("word = ''").select("kind", F.col("n").alias("lines"))
    seen = st.where("word != ''").join(lines, "kind", "left")
    closing = ask.select("kind", "word").where("word != ''").distinct()
    own = closing.join(seen, ["kind", "word"], "left")
    head = F.substring("word", 1, 2)
    longer = seen.select("kind", head.alias("_head"), F.col("word").alias("_long"), F.col("n").alias("_n"))
    n = F.coalesce("n", F.lit(0))
    only = own.where((n < CLOSES_LEAST) | (F.col("m") == F.col("n")))
    known = (F.col("_n") >= CLOSES_LEAST) & (n <= PIECE_SHARE * F.col("_n"))
    part = only.withColumn("_head", head).join(longer, ["kind", "_head"]).where(F.col("_long").startswith(F.col("word")) & (F.col("_long") != F.col("word")) & known).select("kind", "word").distinct()
    is_class = F.col("word").startswith("<") | F.col("kind").startswith("ref:")
    seldom = F.when(is_class, F.col("m") < CLASS_SHARE * F.col("lines")).otherwise((F.col("n") >= CLOSES_LEAST) & (F.col("m") < CLOSES_SHARE * F.col("n")))
    open_ = own.where(seldom).select("kind", "word").unionByName(part)
    words = ask.join(open_, ["kind", "word"]).select(*keys, F.lit(2).alias("rank"), F.lit("closing_word").alias("reason"))
    return sure.unionByName(copies).unionByName(words).groupBy(*keys).agg(F.min(F.struct("rank", "reason")).alias("_r")).select(*keys, "_r.reason")


def planted_copies(values: DataFrame) -> DataFrame:
    """(th, tails, text, tenth): for each different text a copy cut at a place chosen by its hash, every other one with a word replaced where that leaves it a near-copy.

    Only cuts inside a line after at least a fifth of the text count, as a copy that
    closes with a sentence is another version and no cut one.  tenth is the share of
    the text that is left, in tenths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for th, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = t.rstrip()
                n = len(t)
                p = n // 5 + (th & 0x7FFFFFFF) % max(1, n - n // 5)
                a = t[:p]
                w = [m.span() for m in _WORD.finditer(a)]
                if not a or a[-1].isspace() or not _goes_on(t[p:]) or closes_sentence(a) or len(w) < SHINGLE:
                    continue
                if th & 1 and len(w) > 15 * SHINGLE:
                    x, y = w[(th >> 8) % (len(w) // 2)]
                    a = a[:x] + "replaced" + a[y:]
                if tails := tail_keys(a):
                    out.append((th, tails, a, 10 * p // n))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int64()), pa.string(), pa.int32()), strict=True)], names=["th", "tails", "text", "tenth"])

    once = values.select(F.xxhash64("text").alias("th"), "text").dropDuplicates(["th"])
    return once.mapInArrow(run, "th long, tails array<long>, text string, tenth int")


def copy_recall(values: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(tenth, n_planted, n_found, recall): how many planted cut copies of the values are found by their source."""
    ws = ws or Workspace(values.sparkSession, "truncation")
    planted = ws.write(planted_copies(values), "planted")
    hit = near_copies(planted, values, ws).withColumn("_hit", F.lit(1))
    out = planted.join(hit, "th", "left").groupBy("tenth").agg(F.count("*").alias("n_planted"), F.count("_hit").alias("n_found"))
    return out.withColumn("recall", F.col("n_found") / F.col("n_planted"))


def cut_rates(values: DataFrame, cut: DataFrame) -> DataFrame:
    """(provider, table_name, field, n_values, n_cut, share) per source and field."""
    v = values.select("table_name", "row_id", "field", "source").dropDuplicates(["table_name", "row_id", "field"])
    j = v.join(cut.withColumn("_c", F.lit(1)), ["table_name", "row_id", "field"], "left")
    out = j.groupBy(F.col("source").alias("provider"), "table_name", "field").agg(F.count("*").alias("n_values"), F.count("_c").alias("n_cut"))
    return out.withColumn("share", F.col("n_cut") / F.col("n_values"))
