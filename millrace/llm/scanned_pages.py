"""Text of scanned pages repaired into continuous paragraphs.

The lines of a page are labelled as top furniture, body or bottom furniture by a linear conditional model over the sequence:
each line has layout features (position, likeness to the title, page number forms, rules, sentence ends, headings, how often
the same line stands at this margin in the whole collection), each label weighs them, and Viterbi finds the best sequence of
top*, body*, bottom*. Body lines are then joined into paragraphs, over the ends of pages too: words cut by a mark are closed,
misread characters replaced.

The weights are fitted on one group of pages (about ``GROUP_CHARACTERS``, dealt by hash): lines that recur at the margins of
many pages and page numbers are taken for furniture, long sentences and lines amid the page for body, all others are left open.
A latent structured perceptron starts at the stated weights and is corrected where its best sequence contradicts these labels.

Which words exist, and which characters stand in which context, is counted over the whole collection; each group of pages gets
the counts that it asks for (grouped_counts), so no place holds a vocabulary and there is no bound on it.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.grouped_counts import Asked, Totals, collection_totals

LEAST_COUNT = 3
GROUP_CHARACTERS = 500_000
EPOCHS, STEP = 3, 0.1

# Characters and letter groups that scans take for each other, misread form first.
HAN_MISREAD = "可司埋理验险仂份末未未末兀元枸构尸户台合走定倩债仕任凤风贸资午年入人人入木本颔额曰日布市卒率忆亿忖付此比顶项己已徽微土士干千大太天夫贝见车东曰目申甲由田问间侍待持特扱报杋机祉社"
WORD_MISREAD = [("b", "h"), ("h", "b"), ("d", "cl"), ("cl", "d"), ("m", "rn"), ("rn", "m"), ("u", "n"), ("n", "u"), ("c", "e"), ("e", "c"), ("vv", "w"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("l", "i"), ("i", "l")]
DIGIT_MISREAD = {"o": "0", "O": "0", "l": "1", "I": "1", "S": "5", "B": "8", "b": "6", "Z": "2"}
LOST = "■□�"

CONFUSED: dict[str, list[str]] = {}
for _a, _b in zip(HAN_MISREAD[::2], HAN_MISREAD[1::2]):
    CONFUSED.setdefault(_a, []).append(_b)
CENTRES = "".join(sorted(set(HAN_MISREAD)))

MOST_FRONT_PAGES = 12  # printed page numbers may run ahead of the page column by the pages before the first
DIGIT = "[0-9oOlISBb]"
STRONG_NUMBER = re.compile(rf"^(?:第\s*{DIGIT}{{1,4}}\s*页(?:\s*[,，/]?\s*共\s*{DIGIT}{{1,4}}\s*页)?|第[一二三四五六七八九十百]+页|{DIGIT}{{1,4}}\s*/\s*{DIGIT}{{1,4}}|[·•]\s*{DIGIT}{{1,4}}\s*[·•]|[Pp]age\s+{DIGIT}{{1,4}}(?:\s+of\s+{DIGIT}{{1,4}})?|[-—–]\s*{DIGIT}{{1,4}}\s*[-—–])$")
BARE_NUMBER = re.compile(r"^[0-9oOlI]{1,4}$")
RULE = re.compile(r"^[-—–_=─━*~]{4,}$")
SENTENCE_END = re.compile(r"[。！？；;.!?：:，,、]$")
HEADING = re.compile(r"^(?:第[一二三四五六七八九十百零〇\d]+[章节条编部]|[一二三四五六七八九十]+、|[（(][一二三四五六七八九十]+[）)]|\d+(?:\.\d+)+\s)")
DATE = re.compile(r"^[0-9oOlISBb]{4}年(?:[0-9oOlISBb]{1,2}月(?:[0-9oOlISBb]{1,2}日)?)?$")
TRAILING_NUMBER = re.compile(r"\s{2,}[0-9oOlISBb]{1,4}$")
WORD = re.compile("[A-Za-z]+")
CUT_MARK = re.compile(r"([A-Za-z0-9]+)([-‐­¬])\s*$")
MIXED_NUMBER = re.compile(r"(?<![A-Za-z0-9.,-])(?=[0-9.,]*[oOlISBbZ])(?=[oOlISBbZ.,]*[0-9])[0-9oOlISBbZ][0-9oOlISBbZ.,]*(?![A-Za-z0-9])")
MIXED_WORD = re.compile(r"(?<![A-Za-z0-9-])(?:[A-Za-z]+[01589][a-z]+|[01][a-z]+|[A-Za-z]*[a-z]{2}[01])(?![A-Za-z0-9-])")
TRIGRAM = re.compile(f"(?=(.[{CENTRES}].))", re.S)
JOINED = re.compile(r"(?<=[㐀-鿿，。；、）（0-9%])\n(?=[㐀-鿿，。；、）（0-9%])")


@lru_cache(1 << 16)
def mask(line: str) -> str:
    return re.sub(r"\s+", " ", re.sub("[0-9]+", "9", line.strip()))


def own_counts(total: Counter, text: str, title: str | None) -> None:
    """Adds what a page has: lines at the margins, words, characters in context, the end of its title."""
    lines = [line for line in text.split("\n") if line.strip()]
    total["pages", ""] += 1
    for place, margin in (("top", lines[:2]), ("bottom", lines[2:][-2:])):
        for line in margin:
            if len(line) <= 60:
                total[place, mask(line)] += 1
    for line in lines:
        if len(line) <= 60:
            total["line", mask(line)] += 1
    for word in WORD.findall(text):
        total["word", word.lower()] += 1
    for gram in TRIGRAM.findall(JOINED.sub("", text)):
        total["gram", gram] += 1
        total["gram", gram[:2] + "?"] += 1
        total["gram", "?" + gram[1:]] += 1
    if title:
        total["ending", title[-2:]] += 1


def asked_counts(asked: Asked, text: str, page: int | None) -> None:
    """Notes every count that the repair of a page may ask for, whichever of its lines turn out to be body."""
    lines = [line for line in text.split("\n") if line.strip()]
    for number, line in enumerate(lines):
        following = lines[number + 1] if number + 1 < len(lines) else ""
        line_features(line, number, len(lines), page, "", asked)
        repair_line(line, lines[number - 1][-1:] if number else "", following[:1], asked)
        cut_word(line, following, asked["word"])


def parts_of(text: str, page: int | None, whole: bool) -> list[tuple[str, int | None]]:
    """(text, page number) of the pages of a row: one, or those of a document that are joined by form feeds."""
    return [(part, i + 1) for i, part in enumerate(text.split("\f"))] if whole else [(text, page)]


def _rows_of(group: pa.Table) -> list[tuple]:
    """(doc_id, page, text, title, whole) of a group, redelivered rows once."""
    return list(dict.fromkeys(zip(*(group[c].to_pylist() for c in ("doc_id", "page", "text", "title", "whole")))))


def _listed(group: pa.Table) -> Counter:
    total: Counter = Counter()
    asked = Asked(total)
    for _, page, text, title, whole in _rows_of(group):
        for part, number in parts_of(text, page, whole):
            own_counts(total, part, title)
            asked_counts(asked, part, number)
    return total


def likeness(line: str, title: str) -> float:
    """Share of the line's pairs of characters that the title has too."""
    pairs = {line[i : i + 2] for i in range(len(line) - 1)}
    return len(pairs & {title[i : i + 2] for i in range(len(title) - 1)}) / len(pairs) if pairs else 0.0


# Weights of the line features for the labels top, body, bottom, from which the fit starts.
WEIGHTS = {
    "bias": (0.0, 0.5, 0.0),
    "blank": (0.0, 0.2, 0.0),
    "title": (5.0, -2.0, 0.0),
    "title ending": (2.5, -0.5, 0.0),
    "trailing number": (3.0, -1.0, 1.0),
    "page number": (4.0, -5.0, 5.0),
    "page column": (3.5, -3.0, 4.0),
    "other number": (-3.0, 2.0, -3.0),
    "rule": (4.0, -4.0, 4.0),
    "frequent top": (0.5, 0.0, 0.0),
    "frequent bottom": (0.0, -2.0, 4.0),
    "sentence": (-4.0, 3.0, -4.0),
    "heading": (-5.0, 3.0, -4.0),
    "date": (-3.0, 2.0, -3.0),
    "far": (-3.0, 0.0, -3.0),
    "long": (-2.0, 1.0, -3.0),
    "latin": (-2.0, 1.0, -2.0),
}


def line_features(line: str, number: int, n: int, page: int | None, title: str, model: dict) -> list[str]:
    text = line.strip()
    if not text:
        return ["blank"]
    out = ["bias"]
    core = TRAILING_NUMBER.sub("", text)
    pages = max(model["pages"].get("", 1), 1)
    masked = mask(text)
    often, at_margin = model["line"].get(masked, 0), {place: model[place].get(masked, 0) for place in ("top", "bottom")}
    ending = model["ending"].get(core[-2:], 0)
    numeric = False
    if STRONG_NUMBER.match(text):
        out.append("page number")
        numeric = True
    elif BARE_NUMBER.match(text):
        value = int("".join(DIGIT_MISREAD.get(c, c) for c in text))
        near = abs(value - page) <= MOST_FRONT_PAGES if page is not None else value <= 60
        out.append("page column" if near and len(text) < 4 else "other number")
        numeric = True
    elif RULE.match(text):
        out.append("rule")
        numeric = True
    if numeric:
        return [*out, "far"] if 3 < number < n - 3 else out
    if core != text:
        out.append("trailing number")
    likely = max(likeness(core, title), likeness(core.rsplit(" ", 1)[-1], title)) if title else 0.0
    if likely >= 0.6 and not SENTENCE_END.search(core):
        out.append("title")
    elif not title and ending >= LEAST_COUNT and len(core) < 40 and "，" not in core and "。" not in core:
        out.append("title ending")
    for place, share in (("top", 0.002), ("bottom", 0.01)):
        # A running line stands at its margin nearly wherever it stands; a frequent heading or table cell doesn't.
        count = 0 if title and place == "top" else at_margin[place]
        if count >= max(LEAST_COUNT, share * pages) and count >= 0.8 * often and re.search("[㐀-鿿A-Za-z]{3}", text) and not SENTENCE_END.search(text):
            out.append(f"frequent {place}")
    if SENTENCE_END.search(text) or re.search("[，。；]", text):
        out.append("sentence")
    if HEADING.match(text):
        out.append("heading")
    if DATE.match(text):
        out.append("date")
    if len(text) > 45:
        out.append("long")
    if len(WORD.findall(text)) >= 4:
        out.append("latin")
    return [*out, "far"] if 3 < number < n - 3 else out


def best_sequence(features: list[list[str]], weights: dict, allowed: list[tuple[int, ...]] | None = None) -> list[int]:
    """The best non-falling sequence of labels; ``allowed`` restricts the labels of each line."""
    best, back = [0.0, 0.0, 0.0], []
    for number, own in enumerate(features):
        gain = [sum(w) for w in zip(*(weights[f] for f in own if f in weights), (0.0, 0.0, 0.0))]
        came, now = [], []
        for state in range(3):
            before = max(range(state + 1), key=lambda s: best[s])
            came.append(before)
            now.append(best[before] + gain[state] if allowed is None or state in allowed[number] else -1e9)
        back.append(came)
        best = now
    state = max(range(3), key=lambda s: best[s]) if features else 1
    out = []
    for came in reversed(back):
        out.append(state)
        state = came[state]
    return out[::-1]


def label_lines(lines: list[str], page: int | None, title: str, model: dict, weights: dict = WEIGHTS) -> list[int]:
    """0 (top furniture), 1 (body) or 2 (bottom furniture) of each line, by the best non-falling sequence."""
    return best_sequence([line_features(line, number, len(lines), page, title, model) for number, line in enumerate(lines)], weights)


def weak_labels(lines: list[str], model) -> list[tuple[int, ...]]:
    """The labels that each line may have by what is known without a model."""
    pages = max(model["pages"].get("", 1), 1)
    filled = [i for i, line in enumerate(lines) if line.strip()]
    top, bottom = set(filled[:2]), set(filled[2:][-2:])
    out: list[tuple[int, ...]] = []
    for i, line in enumerate(lines):
        text = line.strip()
        masked = mask(text) if text else ""
        margin = max(model["top"].get(masked, 0), model["bottom"].get(masked, 0))
        recurs = margin >= max(5, 0.01 * pages) and margin >= 0.8 * model["line"].get(masked, 0) and re.search("[㐀-鿿A-Za-z]{3}", text) and not re.search("[，。；]", text)
        if not text:
            out.append((0, 1, 2))
        elif i in top and (STRONG_NUMBER.match(text) or recurs):
            out.append((0,))
        elif i in bottom and (STRONG_NUMBER.match(text) or recurs):
            out.append((2,))
        elif len(text) > 20 and re.search("[，。；]", text) or i not in top | bottom and 3 < i < len(lines) - 4:
            out.append((1,))
        else:
            out.append((0, 1, 2))
    return out


def fit(pages: list[tuple[list[list[str]], list[tuple[int, ...]]]], epochs: int = EPOCHS, step: float = STEP) -> dict[str, tuple[float, float, float]]:
    """Weights from (features of the lines, labels that they may have) of each page, averaged over all updates."""
    weights = {f: list(w) for f, w in WEIGHTS.items()}
    total = {f: [0.0, 0.0, 0.0] for f in weights}
    seen = 0
    for _ in range(epochs):
        for features, allowed in pages:
            found = best_sequence(features, weights)
            if any(state not in a for state, a in zip(found, allowed)):
                wanted = best_sequence(features, weights, allowed)
                if all(state in a for state, a in zip(wanted, allowed)):  # labels may contradict the order of a page
                    for own, right, wrong in zip(features, wanted, found):
                        if right != wrong:
                            for f in own:
                                weights[f][right] += step
                                weights[f][wrong] -= step
            seen += 1
            for f, w in weights.items():
                for state in range(3):
                    total[f][state] += w[state]
    return {f: tuple(x / seen for x in w) for f, w in total.items()} if seen else {f: tuple(w) for f, w in WEIGHTS.items()}


def _fit_group(group: pa.Table) -> pa.Table:
    """Weights fitted on one group of pages by that group's own counts."""
    rows, total = _rows_of(group), Counter()
    pages = [(part, number, title) for _, page, text, title, whole in rows for part, number in parts_of(text, page, whole)]
    for part, _, title in pages:
        own_counts(total, part, title)
    model: dict[str, dict[str, int]] = {kind: {} for kind in ("pages", "top", "bottom", "line", "word", "gram", "ending")}
    for (kind, entry), n in total.items():
        if n >= LEAST_COUNT or kind == "pages":
            model[kind][entry] = n
    made = []
    for part, number, title in pages:
        lines = part.split("\n")
        made.append(([line_features(line, i, len(lines), number, title or "", model) for i, line in enumerate(lines)], weak_labels(lines, model)))
    weights = fit(made)
    return pa.table({"feature": pa.array(list(weights), pa.string()), **{label: pa.array([w[i] for w in weights.values()], pa.float64()) for i, label in enumerate(("top", "body", "bottom"))}})


def better_word(word: str, words: dict[str, int]) -> str | None:
    """The frequent word that ``word`` is a misread form of."""
    known = getattr(words, "known", {})
    if word not in known:
        known[word] = _better_word(word, words)
    return known[word]


def _better_word(word: str, words) -> str | None:
    low = word.lower()
    own = words.get(low, 0)
    best, most = None, max(5, 20 * own)
    for wrong, right in WORD_MISREAD:
        at = low.find(wrong)
        while at >= 0:
            other = low[:at] + right + low[at + len(wrong) :]
            there = words.get(other, 0)
            if there >= most:
                best, most = other, there
            at = low.find(wrong, at + 1)
    return best and (best.capitalize() if word[0].isupper() else best)


def better_han(before: str, char: str, after: str, grams: dict[str, int]) -> str | None:
    """The character that ``char`` is a misread form of, in this context."""
    own = grams.get(before + char + after, 0)
    for other in CONFUSED[char]:
        there = grams.get(before + other + after, 0)
        if there >= 5 and own * 10 <= there:
            return other
        left, right = grams.get(before + other + "?", 0), grams.get("?" + other + after, 0)
        own_left, own_right = grams.get(before + char + "?", 0), grams.get("?" + char + after, 0)
        if there * 3 >= own and (left >= 20 and own_left * 20 <= left and own_right * 2 <= right or right >= 20 and own_right * 20 <= right and own_left * 2 <= left):
            return other
    return None


def repair_line(line: str, before: str, after: str, model: dict) -> tuple[str, bool]:
    """The line with misread characters replaced, and whether it has any misread or lost character.

    ``before`` and ``after`` are the characters next to the line in the running text.
    """
    wrong = any(c in line for c in LOST)

    def number(match: re.Match) -> str:
        nonlocal wrong
        wrong = True
        return "".join(DIGIT_MISREAD.get(c, c) for c in match[0])

    def mixed(match: re.Match) -> str:
        nonlocal wrong
        wrong = True
        return better_word(match[0], model["word"]) or match[0]

    def word(match: re.Match) -> str:
        nonlocal wrong
        if len(match[0]) < 3 or match.start() == 0 or match.end() == len(fixed):
            return match[0]
        other = better_word(match[0], model["word"])
        if other is None:
            return match[0]
        wrong = True
        return other

    fixed = MIXED_WORD.sub(mixed, MIXED_NUMBER.sub(number, line))
    fixed = WORD.sub(word, fixed)
    if any(c in CONFUSED for c in fixed):
        chars = list(before + fixed + after)
        for i in range(len(before), len(before) + len(fixed)):
            if chars[i] in CONFUSED and 0 < i < len(chars) - 1:
                other = better_han(chars[i - 1], chars[i], chars[i + 1], model["gram"])
                if other:
                    chars[i] = other
                    wrong = True
        fixed = "".join(chars[len(before) : len(before) + len(fixed)])
    return fixed, wrong


def cut_word(line: str, following: str, words: dict[str, int]) -> str | None:
    """The mark by which the line's last word is cut and goes on in ``following``; None where it isn't."""
    match = CUT_MARK.search(line)
    if not match or not following:
        return None
    rest = re.match("[A-Za-z0-9]+", following.lstrip())
    head, mark = re.sub("^[0-9]+", "", match[1]), match[2]
    if mark != "-":
        return mark
    if not rest or not head or not re.match("[a-z01]", rest[0]):
        return None
    whole, first, second = (words.get(w.lower(), 0) for w in (head + rest[0], head, rest[0]))
    return mark if whole or not (first and second) else None


def printed_width(line: str) -> int:
    """Width in print: Han characters and full-width marks are twice as wide as letters."""
    return len(line) + sum(c > "⺀" for c in line)


def repair_text(parts: list[tuple[str, int | None]], title: str | None, model, weights: dict = WEIGHTS) -> tuple[list[list[tuple[int, str]]], str, bool]:
    """What is wrong in each page, the text of all pages in paragraphs, and whether its last paragraph is left open.

    A page that doesn't end with a sentence goes on in the body of the next one, a word cut there is closed.
    """
    found: list[list[tuple[int, str]]] = [[] for _ in parts]
    body: list[tuple[int, int, str]] = []  # page, line, text
    for at, (text, page) in enumerate(parts):
        lines = text.split("\n")
        labels = label_lines(lines, page, title or "", model, weights)
        for i, (line, label) in enumerate(zip(lines, labels)):
            if line.strip() and label != 1:
                found[at].append((i + 1, "furniture"))
            elif line.strip():
                body.append((at, i, line))
    widths: dict[int, int] = {}
    for at, _, line in body:
        widths[at] = max(widths.get(at, 0), printed_width(line))
    paragraphs: list[str] = []
    open_, goes_on = "", False
    for k, (at, i, line) in enumerate(body):
        next_at, next_i, following = body[k + 1] if k + 1 < len(body) else (at, i + 1, "")
        fixed, wrong = repair_line(line, body[k - 1][2][-1:] if k else "", following[:1], model)
        if wrong:
            found[at].append((i + 1, "misread"))
        mark = cut_word(line, following, model["word"])
        if mark:
            found[at].append((i + 1, "hyphen"))
            open_ += CUT_MARK.sub(r"\1", fixed)
            continue
        open_ += fixed.strip()
        ended = re.search(r"[。！？.!?]$", fixed.strip())
        turns = next_at != at
        ends = ended and (turns or printed_width(line) < 0.8 * widths[at])
        blank_next = not turns and next_i != i + 1
        short = not turns and printed_width(fixed.strip()) < 0.5 * widths[at] and not SENTENCE_END.search(fixed.strip())
        goes_on = not (ended or HEADING.match(fixed))
        if not following or ends or blank_next or HEADING.match(following) or HEADING.match(fixed) or short:
            paragraphs.append(open_)
            open_ = ""
        elif re.search(r"[A-Za-z0-9.,;:)%]$", open_) and re.match(r"[A-Za-z(]", following):
            open_ += " "
    return [sorted(f) for f in found], "\n".join(paragraphs + ([open_] if open_ else [])), bool(open_) or goes_on


def repair_page(text: str, page: int | None, title: str | None, model, weights: dict = WEIGHTS) -> tuple[list[tuple[int, str]], str]:
    """((line number, kind) of what is wrong, the repaired text in paragraphs) of a single page."""
    found, clean, _ = repair_text([(text, page)], title, model, weights)
    return found[0], clean


FOUND = pa.list_(pa.struct([("page", pa.int32()), ("line_no", pa.int32()), ("kind", pa.string())]))
REPAIRED = "doc_id string, page int, found array<struct<page: int, line_no: int, kind: string>>, clean string, goes_on boolean"


def _repair(weights: dict):
    def repair(group: pa.Table, answers: pa.Table) -> pa.Table:
        rows, model = _rows_of(group), Totals(answers, LEAST_COUNT)
        done = []
        for doc, page, text, title, whole in rows:
            parts = parts_of(text, page, whole)
            found, clean, goes_on = repair_text(parts, title, model, weights)
            done.append((doc, page, [{"page": number, "line_no": n, "kind": kind} for (_, number), own in zip(parts, found) for n, kind in own], clean, goes_on))
        columns = list(zip(*done)) or [()] * 5
        kinds = [pa.string(), pa.int32(), FOUND, pa.string(), pa.bool_()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "page", "found", "clean", "goes_on"])

    return repair


def _repaired(rows: DataFrame) -> DataFrame:
    """Repairs (doc_id, page, text, title, whole); every row belongs to the group of its hash."""
    n_groups = 1 + (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // GROUP_CHARACTERS
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "page", "text"), F.lit(n_groups)).cast("int").alias("g"), "doc_id", "page", "text", "title", "whole")
    fitted = dealt.filter("g = 0").groupBy("g").applyInArrow(_fit_group, "feature string, top double, body double, bottom double").collect()  # one row a feature
    weights = {row["feature"]: (row["top"], row["body"], row["bottom"]) for row in fitted} or WEIGHTS
    # A stated number of partitions: the work is in Python, so small partitions mustn't be joined to few tasks by their bytes.
    dealt = dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g")
    answers = collection_totals(dealt, _listed, -(-n_groups // 2), LEAST_COUNT)
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_repair(weights), REPAIRED)


def repair_pages(pages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, found, clean, goes_on) of each page: what was wrong in which line (from 1), the repaired text, and whether its
    last paragraph goes on in the next page.

    ``pages`` has doc_id, page, text, ``titles`` doc_id, title (used to know a header). Null texts are left out, empty ones
    have an empty result; a null page stays null. Redelivered rows (same doc_id, page and text) count once. Lines are split at
    each line feed, empty ones counted. A page goes to a group by the hash of the whole row, so a document with many is spread.
    """
    pages = pages.filter("text is not null").select("doc_id", F.col("page").cast("int").alias("page"), "text", F.lit(False).alias("whole"))
    if titles is None:
        pages = pages.withColumn("title", F.lit(None).cast("string"))
    else:
        pages = pages.join(titles.groupBy("doc_id").agg(F.max("title").alias("title")), "doc_id", "left")
    return _repaired(pages).withColumn("found", F.transform("found", lambda f: F.struct(f["line_no"].alias("line_no"), f["kind"].alias("kind"))))


def repair_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, n_found, clean) of documents whose raw_text holds pages joined by form feeds: one continuous text over all pages.

    ``documents`` has doc_id, title, raw_text. Null texts are left out, redelivered rows count once.
    """
    rows = documents.filter("raw_text is not null").select("doc_id", F.lit(None).cast("int").alias("page"), F.col("raw_text").alias("text"), "title", F.lit(True).alias("whole"))
    return _repaired(rows).select("doc_id", F.size("found").alias("n_found"), "clean")
