"""Text quality statistics per document and the share of its characters that belong to running sentences.

Layout first, block by block: fenced code, tables (vertical alignment of delimiters over neighbouring lines), logs and traces,
lists (bullets, periodic indents, line lengths that correlate with their neighbours', short lines without end marks). Then
ratios: a block whose ink is mostly symbols and digits, or whose words are far too long or too few a line, is no prose. What is
left is cut into units (sentences; whole paragraphs where lines are wrapped without punctuation; else lines), and a unit counts
as a sentence by the shares of words, letters, distinct and common words in it. Layout and ratios can't tell words in a heap
from a sentence of the same words; that takes the order of function words (:func:`disorder`), known for some languages. Units
without a known word are judged by the shape of their words alone.

Defined cases: null text gives null statistics, empty and blank text zeros, shares of nothing are 0.0. Whole texts only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ship, spread

#: Function words added to the table of common words, which lacks some languages and many short words.
FUNCTION_WORDS = {
    "en": "the a an of and to in is it that for was on are as with be at by this not but or from have they which you we all when there their if will has been would so no more than can only its our what does had most how any i he she my your his her do did were could should may might must into over about after before because since while until where who whom then them these those such each every both either neither nor also very just still too out up down off again once here why whether though although unless",
    "de": "der die das und ist nicht in ein zu den mit sich auf für im dem es von wird nur noch wer wir ob wenn auch weil hat sobald nach einem bitte zum eine einen einer eines als aus bei bis durch ich du er sie ihr man so wie war waren sind sein werden kann aber oder sondern dass daß da doch um am vom zur über unter vor alle alles später zuerst neu",
    "fr": "le la les de des et est un une que ne pas dans pour on du mais car avant nous il a ce plus sur dès même soit après cette au aux avec par qui ou où se son sa ses leur sont était été je tu elle ils elles vous en y si sans sous comme donc fait être avoir",
    "es": "el la los las de y en que no un una es se para por con cuando porque pero sino hay antes del al como más aunque después sigue nadie lo le su sus o u si ya está estaba son era fue ser haber ha han muy sin sobre entre hasta desde donde quien yo tú él ella nosotros todo todos",
    "nl": "de het een en van is in op te dat die niet met voor zijn was er maar aan om ook als dan bij nog naar uit door over ze hij zij wij we je ik hebben heeft had werd wordt worden zodra wanneer dus alleen eerst deze dit lang pas geen wel daar hier wie wat of",
}
_DOMESTIC = frozenset(w for v in FUNCTION_WORDS.values() for w in v.split())
_INVISIBLE = dict.fromkeys(map(ord, "\u200b\u200c\u200d\u2060\ufeff\u00ad"), None) | {0xA0: " ", 0x202F: " ", 0x2009: " ", 0x3000: " "}
_UNSEEN = re.compile("[" + "".join(map(chr, _INVISIBLE)) + "]")
_LINE_END = re.compile("\r\n?|[\u2028\x0b\x0c\x85]")
_OTHER, _SYMBOLS = re.compile(r"[^\w\s]|[\d_]"), re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TOKEN = re.compile(r"`[^`\n]*`|<[^<>\s]*>|[^\W_]+(?:[_:./'’-]+[^\W_]+)*")
_FENCE = re.compile(r"^\s*(```|~~~)")
_BULLET = re.compile(r"^\s*(?:[-*+•·–‣◦]|\d{1,3}[.)]|[a-z][.)]|\[[ xX]?\])\s+")
_STAMP = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\d\d:\d\d:\d\d\b|(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL)\b[ :\[])")
_FRAME = re.compile(r"^\s*(?:at\s+\S+\s*\(.*\)|at\s+\S+:\d+(?::\d+)?|File \".*\", line \d+.*|#\d+\s+0x[0-9a-f]+.*|\.\.\. \d+ more|Caused by: .*|\S+\([^()]*\.\w+:\d+(?::\d+)?\))\s*$")
_BORDER = re.compile(r"^[\s|+:=─━┼╋│┃┬┴├┤*~_-]{3,}$")
_END = re.compile(r"(?<=[.?!…。！？])[\"'”’»)\]]*(?:\s+|$)|(?<=[。！？])")
_MARK = re.compile(r"[.?!…。！？](?=\s|$|[\"'”)])")
_WIDE = re.compile(r"(?<=\S)[ \t]{2,}(?=\S)")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_GAPS = re.compile(r"\S(?: {2,}|\t+)(?=\S)")
_CODE = re.compile(r"\s*[{}()\[\]]+[;,]?\s*$|\s*(?:let|const|var|fn|pub|local|return|import|use|#include|function|def|class|struct|for|while|if|end|else)\b.*[(){};=]|\s*(?://|/\*|--\s|\*/)|\s*[\w.\[\]\"']+\s*(?:[-+*/|&]?=|:=|=>|->)\s*\S|\s*\"[^\"]*\"\s*:\s")


def _cells(line: str, sep: str) -> int:
    return line.strip().strip("|").count(sep) if sep == "|" else line.count(sep)


def autocorrelation(lengths: list[int]) -> float:
    """Lag-1 similarity of line lengths: 1.0 when all lines are about as long as their neighbours, 0.0 when unrelated."""
    if len(lengths) < 3:
        return 0.0
    mean = sum(lengths) / len(lengths)
    var = sum((x - mean) ** 2 for x in lengths)
    if var <= 1e-9 or var / len(lengths) < (0.04 * mean) ** 2:
        return 1.0
    return max(0.0, sum((a - mean) * (b - mean) for a, b in zip(lengths, lengths[1:])) / var)


def table_lines(lines: list[str]) -> list[bool]:
    """Lines whose delimiters line up with a neighbour's: pipes, tabs, commas without blanks, or columns of gaps."""
    n = len(lines)
    marks = [False] * n
    joined = "\n".join(lines)
    for sep, least in (("|", 1), ("\t", 1), (",", 1), (";", 1)):
        if sep not in joined:
            continue
        counts = [_cells(s, sep) for s in lines]
        for i in range(n):
            if counts[i] < least:
                continue
            near = [j for j in (i - 1, i + 1) if 0 <= j < n and counts[j] == counts[i]]
            if not near:
                continue
            if sep in ",;":
                tight = [k for k in (i, *near) if lines[k].count(sep + " ") == 0 and not lines[k].rstrip().endswith(sep)]
                if len(tight) != 1 + len(near) or (counts[i] < 2 and sum(len(lines[k].split()) for k in tight) > 5 * len(tight)):
                    continue
            if sep == "|" and counts[i] < 2 and "|" not in (lines[i].strip()[:1], lines[i].strip()[-1:]):
                continue
            marks[i] = True
    gaps = [{m.end() for m in _GAPS.finditer(s)} for s in lines] if "  " in joined or "\t" in joined else [set()] * n
    for i in range(n):
        if len(gaps[i]) >= 2 and any(0 <= j < n and len(gaps[i] & gaps[j]) >= max(2, min(len(gaps[i]), len(gaps[j])) // 2) for j in (i - 1, i + 1)):
            marks[i] = True
    for i in range(n):
        if not marks[i] and _BORDER.match(lines[i]) and len(lines[i].strip()) >= 3:
            marks[i] = True
    return marks


def shaped(words: list[str], ended: bool) -> bool:
    """Do words of an unknown language look like a sentence? Words of ordinary and uneven length, few of them alike, few
    capitals behind the first one; an end mark, or more of them."""
    sizes = [len(w) for w in words]
    mean = sum(sizes) / len(sizes)
    if not 2.5 <= mean <= 11 or len(set(map(str.lower, words))) < 0.6 * len(words):
        return False
    uneven = sum(abs(x - mean) for x in sizes) / len(sizes) >= 0.2 * mean
    capitals = sum(w[0].isupper() for w in words[1:])
    return uneven and capitals <= 0.34 * len(words) and len(words) >= (4 if ended else 8)


def is_sentence(unit: str, alone: bool, common: frozenset[str] = _DOMESTIC, orderly: bool = False) -> bool:
    """Do the words of ``unit`` run as a sentence? ``alone``: it stands on a line of its own without end mark; ``orderly``: the
    text it is part of has too few words in disorder for any unit of it to be a heap."""
    text = unit.strip()
    if not text.isascii() and len(cjk := _CJK.findall(text)) >= 4 and len(cjk) > 0.3 * len(text):
        return len(set(cjk)) > 0.35 * len(cjk) or len(set(cjk)) > 30
    tokens = _TOKEN.findall(text)
    if len(tokens) < 4:
        return False
    spelled = [t for t in tokens if t.isalpha() or t[0] not in "`<" and _WORD.fullmatch(t)]
    words = [t.lower() for t in spelled]
    spans = sum([t[0] == "`" for t in tokens]) if "`" in text else 0
    if len(words) < 3 or len(words) + spans < 0.6 * len(tokens):
        return False
    letters = len(_OTHER.sub("", text))
    if letters + (sum([len(t) for t in tokens if t[0] == "`"]) if spans else 0) < 0.75 * len(text):
        return False
    distinct = len(set(words))
    if len(words) >= 6 and distinct < 0.4 * len(words) and distinct < 12:
        return False
    if max(map(len, words)) > 22 and sum([len(w) > 22 for w in words]) > 0.2 * len(words):
        return False
    if (commas := text.count(",")) >= 4 and sum([len(x.split()) for x in text.split(",")]) <= 3.2 * (commas + 1):
        return False
    share = sum(map(common.__contains__, words)) / len(words)
    ended = text[-1] in _ENDS or text.endswith((".`", ":"))
    if share == 0:
        return shaped(spelled, ended)
    if len(tokens) >= 8 and len(tokens) - len(words) + spans > len(words) and share < 0.15:
        return False
    if not orderly:
        heap, clash, n = disorder(text, common)
        if n >= 6 and heap > HEAP or clash >= 2 and clash > CLASH * n:
            return False
    n = len(words) + spans
    if n >= ALONE:
        return True
    return n >= 5 and (share > 0.1 or spans > 0) and (ended or not alone)


#: Words a line must have that stands alone, without an end mark, to be more than a fragment.
ALONE = 8
_ENDS = ".?!…\"'”)。！？"
#: More than this share of a unit's (or a whole block's) words in a heap, and it isn't running text; the same for clashes.
HEAP, HEAP_BLOCK, CLASH, CLASH_BLOCK = 0.75, 0.55, 0.08, 0.035

#: Fixed values per language: (determiners; words that may follow them although they are function words; prepositions;
#: words that never follow a preposition directly).
_ORDER = {
    "en": ("the a an our their its any this every", "more most only one same other such few own is was has would will can does had at for in that by of as over", "of in for on with at from by to into", "is was are has have had would will can does of and or but if when there so they we"),
    "de": ("dem den ein einem einen im zum zur vom", "mehr alle", "mit von für auf nach zu", "ist wird hat und wenn weil sobald ob wir es bitte sich wer"),
    "fr": ("le la les un une des du cette", "plus même", "de dans pour sur avec", "est a mais et car soit il on dès"),
    "es": ("el la los las un una del al", "más que de", "de en para por con", "es hay pero y sino se sigue cuando porque aunque antes después nadie"),
}


def _clashes() -> frozenset[tuple[str, str]]:
    """Pairs of function words that don't follow each other: determiner before function word, preposition before verb or
    conjunction, or a word twice."""
    out = set()
    for lang, (det, may, prep, never) in _ORDER.items():
        words = set(FUNCTION_WORDS[lang].split())
        may = set(may.split())
        if lang == "en":
            any_more = {"any", "this", "every"}
            out |= {(d, w) for d in any_more for w in words - may}
            out |= {(d, w) for d in set(det.split()) - any_more for w in words - {"more", "most", "only", "one", "same", "other", "such", "few", "own", "over"}}
        else:
            out |= {(d, w) for d in det.split() for w in words - may}
        out |= {(a, b) for a in prep.split() for b in never.split()}
        out |= {(w, w) for w in words - {"that", "had", "die", "der", "das", "nous", "vous", "on"}}
    return frozenset(out)


PAIRS = _clashes()
_RUNS = re.compile(r"[^\w\s'’`]+|`[^`]*`")


def disorder(text: str, common: frozenset[str]) -> tuple[float, int, int]:
    """(share of words in heaps, clashing pairs, words): a heap is a run of four or more function words (three count
    half). Punctuation and code break runs and pairs."""
    heap, clash, n = 0.0, 0, 0
    for piece in _RUNS.split(text.lower()):
        words = _WORD.findall(piece)
        n += len(words)
        known = "".join(["1" if w in common else "0" for w in words])
        if "11" in known:
            for run in _KNOWN.findall(known):
                heap += len(run) if len(run) >= 4 else len(run) / 2
            clash += sum([p in PAIRS for p in zip(words, words[1:])])
    return heap / max(1, n), clash, n


#: Runs of three and more known words. Every word of a clashing pair is one of them.
_KNOWN = re.compile("1{3,}")


def wrapped(lines: list[str]) -> float:
    """Share of line breaks that are where a line is full: the next line's first word wouldn't have fitted."""
    if len(lines) < 2:
        return 0.0
    width = max(map(len, lines))
    return sum(len(a) + 1 + len(b.split(None, 1)[0]) > width for a, b in zip(lines, lines[1:])) / (len(lines) - 1)


def _paragraph(lines: list[str], common: frozenset[str]) -> int:
    """Characters of sentences in lines that belong together."""
    joined = "\n".join(lines)
    total = 0
    heap, clash, n = disorder(joined, common)
    if n >= 12 and (heap > HEAP_BLOCK or clash >= 2 and clash > CLASH_BLOCK * n):
        return 0
    orderly = clash < 2 and heap * n <= 6 * HEAP
    words = len(joined.split())
    if (marks := len(_MARK.findall(joined))) and words <= 45 * marks:
        for u in _END.split(joined.replace("\n", " ")):
            if u.strip():
                # A trailing piece without end mark in a paragraph of sentences may lack its mark only.
                total += len(u) + 1 if is_sentence(u, u.strip()[-1] not in ".?!…。！？\"'”)", common, orderly) else 0
        return min(total, len(joined) + 1)
    items = len(lines) >= LISTING_LINES and words < (PARALLEL_WORDS if parallel(lines) else ITEM_WORDS) * len(lines)
    if len(lines) > 1 and words >= 10 and not (items and parallel(lines)) and words >= LINE_WORDS * len(lines) and (wrapped(lines) >= WRAPPED or _breaks_in_sentences(lines)):
        return len(joined) + 1 if is_sentence(joined.replace("\n", " "), False, common, orderly) else 0
    if items:
        return 0
    # One unit per line; a long line may hold several.
    return sum(len(s) + 1 for s in lines if is_sentence(s, True, common, orderly))


#: Share of full lines from which on lines without end marks are one wrapped text; least words a line of such a text; words a
#: line below which several lines without end marks are items of a list.
WRAPPED, LINE_WORDS, ITEM_WORDS = 0.6, 4.0, 6.8
#: Deviation of the words a line, as a share of their mean, from which on lines are cut anywhere.
UNEVEN = 0.3
#: So few different first words for so many lines, and the lines are parallel; words a line below which they are items then;
#: least lines for that.
PARALLEL, PARALLEL_WORDS, PARALLEL_LINES = 0.67, 8.0, 6


def parallel(lines: list[str]) -> bool:
    """Do lines begin alike, as items of a kind do?"""
    return len(lines) >= PARALLEL_LINES and len({s.split(None, 1)[0].lower() for s in lines}) <= PARALLEL * len(lines)


def _breaks_in_sentences(lines: list[str]) -> bool:
    """Lines cut anywhere: their lengths in words differ widely."""
    counts = [len(s.split()) for s in lines]
    mean = sum(counts) / len(counts)
    return len(counts) >= 3 and max(counts) >= 7 and sum((c - mean) ** 2 for c in counts) / len(counts) >= (UNEVEN * mean) ** 2


def indent_period(lines: list[str]) -> int:
    """Least period (2 to 4 lines, run through twice) in which indents that differ come again and again; 0 for none."""
    indents = [len(s) - len(s.lstrip()) for s in (x.expandtabs(4) for x in lines)]
    if len(set(indents)) < 2:
        return 0
    return next((p for p in (2, 3, 4) if len(indents) >= 2 * p and indents[p:] == indents[:-p]), 0)


#: Lines of a listing without bullets: so many at least, with so few end marks a line, and lengths so much alike, or so few words a line.
LISTING_LINES, LISTING_MARKS, LISTING_EVEN, NAME_WORDS = 4, 0.25, 0.9, 3.0


def is_listing(lines: list[str]) -> bool:
    """Does a block without bullets list things? Its indents are periodic, its lines hold very few words, or they are about as
    long as their neighbours and all begin with a capital or a digit. Wrapped text is told by its end marks."""
    if len(lines) < LISTING_LINES or len(_MARK.findall("\n".join(lines))) > LISTING_MARKS * len(lines):
        return False
    text = " ".join(lines)
    if indent_period(lines) or len(_TOKEN.findall(text)) < NAME_WORDS * len(lines) and not _CJK.search(text):
        return True
    heads = [s.lstrip()[:1] for s in lines]
    if not all(c.isupper() or c.isdigit() for c in heads):
        return False
    return autocorrelation([len(s.strip()) for s in lines]) >= LISTING_EVEN


#: Ratios of a block that no prose has: so large a share of symbols and digits in its ink, or words so long or so short.
INK_SYMBOLS, LONG_WORDS, SHORT_WORDS = 0.4, 14.0, 1.8


def unlike_prose(lines: list[str], common: frozenset[str] = _DOMESTIC) -> bool:
    """Is a block no prose by its ratios of symbols to ink and letters to words? A block with a common word isn't judged by
    them: its units are, one by one. Scripts without blanks have no word ratio."""
    text = " ".join(lines)
    if not common.isdisjoint(text.lower().split()):
        return False
    ink = sum(map(len, text.split()))
    letters = len(_OTHER.sub("", text)) - text.count(" ")
    if ink - letters > INK_SYMBOLS * ink + sum(len(x) for x in _SPAN.findall(text)):
        return True
    words = len(_WORD.findall(text))
    return not _CJK.search(text) and not SHORT_WORDS <= letters / max(1, words) <= LONG_WORDS


_SPAN = re.compile(r"`[^`\n]*`")


def _logged(line: str) -> bool:
    """Is a line a log's or a trace's? Both patterns ask for certain marks, which are looked for first."""
    if line.lstrip()[:1] in _STAMP_HEADS and _STAMP.match(line):
        return True
    return any(c in line for c in "(:#\"") and _FRAME.match(line) is not None or "..." in line and _FRAME.match(line) is not None


_STAMP_HEADS = frozenset("[0123456789DIWETF")


def prose_chars(text: str, common: frozenset[str] = _DOMESTIC) -> tuple[int, int, int, int]:
    """(characters in running sentences, in tables, in lists, all) of a text."""
    text = _LINE_END.sub("\n", text.translate(_INVISIBLE) if _UNSEEN.search(text) else text)
    lines = text.split("\n")
    size = len(text.strip())
    prose = tables = lists = 0
    fenced = False
    block: list[str] = []
    blocks: list[list[str]] = []
    for s in lines:
        if _FENCE.match(s):
            fenced = not fenced
            if block:
                blocks.append(block)
                block = []
            continue
        if fenced:
            continue
        if not s.strip():
            if block:
                blocks.append(block)
                block = []
            continue
        block.append(s)
    if block:
        blocks.append(block)
    for b in blocks:
        marks = table_lines(b)
        tables += sum(len(s) + 1 for s, m in zip(b, marks) if m)
        code = [s.rstrip()[-1:] in (";", "{", "}") or bool(_CODE.match(s)) for s in b]
        coded = sum(code) > 0.4 * len(b)
        para: list[str] = []
        item = False
        bullets = [_BULLET.match(s) for s in b]
        n_items = sum(m is not None for m in bullets)
        items = [s[m.end() :] for s, m in zip(b, bullets) if m and s[m.end() :].strip()] if n_items else []
        least = PARALLEL_WORDS if parallel(items) else ITEM_WORDS
        short = len(items) >= 3 and len(_MARK.findall("\n".join(b))) <= LISTING_MARKS * len(items) and len(_TOKEN.findall(" ".join(b))) < least * len(items)
        if not any(marks) and (short or not n_items and is_listing(b) or unlike_prose(b, common)):
            lists += sum(len(s) + 1 for s in b) if not coded else 0
            continue
        for s, m, c, starts in zip(b, marks, code, bullets):
            skip = m or _logged(s) or s.lstrip().startswith("#") or (coded and (c or s[:1] in " \t}")) or s.count("»") + s.count("›") > 0 and s.count("|") > 1
            if skip or starts:
                if para:
                    got = _paragraph(para, common)
                    prose += got
                    lists += 0 if got or not item else sum(len(x) + 1 for x in para)
                    para = []
                item = False
            if skip:
                continue
            if starts:
                item = n_items > 1
                s = s[starts.end() :]
            s = s.strip()
            para.append(_WIDE.sub(" ", s) if "  " in s or "\t" in s else s)
        if para:
            got = _paragraph(para, common)
            prose += got
            lists += 0 if got or not item else sum(len(x) + 1 for x in para)
    return min(prose, size), min(tables, size), min(lists, size), size


STATS = (
    "words bigint, mean_word_length double, symbol_share double, lines bigint, line_punct_share double, common_share double, "
    "line_length_correlation double, table_share double, list_share double, prose_share double"
)
_PUNCT_END = tuple(".?!…;:。！？\"”")


def statistics(text: str | None, lang: str | None, common: dict[str, frozenset[str]], everywhere: frozenset[str]) -> tuple:
    if text is None:
        return (None,) * 10
    body = text.translate(_INVISIBLE) if _UNSEEN.search(text) else text
    words = _WORD.findall(body)
    lines = [s for s in body.splitlines() if s.strip()]
    ink = sum(map(len, body.split()))
    alnum = len(_SYMBOLS.sub("", body))
    known = common.get((lang or "").strip().lower().split("-")[0].split("_")[0], everywhere)
    prose, tables, lists, size = prose_chars(text, everywhere)
    return (
        len(words), sum(map(len, words)) / len(words) if words else 0.0, (ink - alnum) / ink if ink else 0.0, len(lines),
        sum(s.rstrip().endswith(_PUNCT_END) for s in lines) / len(lines) if lines else 0.0,
        sum(map(known.__contains__, map(str.lower, words))) / len(words) if words else 0.0, autocorrelation([len(s) for s in lines]),
        tables / size if size else 0.0, lists / size if size else 0.0, prose / size if size else 0.0,
    )


#: Most rows of the word table that are sent to the executors; it is a lexicon, not data that grows with the corpus.
LEXICON_ROWS = 100_000


def lexicon(words: DataFrame) -> tuple[dict[str, frozenset[str]], frozenset[str]]:
    rows = words.where("word is not null").select(F.lower("lang"), F.lower("word")).distinct().limit(LEXICON_ROWS + 1).collect()
    if len(rows) > LEXICON_ROWS:
        raise ValueError(f"the word table holds more than {LEXICON_ROWS} words; it would not be broadcast safely")
    by: dict[str, set[str]] = {}
    for lang, word in rows:
        by.setdefault(lang or "", set()).add(word)
    for lang, more in FUNCTION_WORDS.items():
        if lang not in by:
            by[lang] = set(more.split())
    return {k: frozenset(v) for k, v in by.items()}, frozenset(w for v in by.values() for w in v) | _DOMESTIC


def text_statistics(docs: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and the statistics of each row, in one narrow pass (no shuffle)."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(lexicon(words))
    names = [c.split()[0] for c in STATS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, everywhere = shared.value
        for b in batches:
            rows = [statistics(t, g, common, everywhere) for t, g in zip(b["__text"], b["__lang"])]
            out = pd.DataFrame(rows, columns=names)
            out["words"], out["lines"] = out["words"].astype("Int64"), out["lines"].astype("Int64")
            out.insert(0, key, b[key].array)
            yield out

    d = spread(docs.select(F.col(key), F.col("text").alias("__text"), F.col("lang").alias("__lang")), key)
    return d.mapInPandas(run, f"`{key}` {dict(d.dtypes)[key]}, {STATS}")


def not_prose(stats: DataFrame, share: float = 0.5) -> DataFrame:
    """Rows with a non-blank text of which less than ``share`` belongs to running sentences."""
    return stats.where((F.col("lines") > 0) & (F.col("prose_share") < share))
