"""Plain versions of the chunkers, line by line, to hold the Spark ones against."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from quarry.operators.chunking import HEADINGS, NO_HEADING

#: What counts as one token.
_TOKEN = re.compile(r"[一-龥]|[A-Za-z0-9À-ɏ]+|[^A-Za-z0-9À-ɏ一-龥 \t\n\r]")


def count_tokens(text: str) -> int:
    return sum(1 for _ in _TOKEN.finditer(text))


def merge_sections(sections: list[str], size: int, overlap: int) -> list[str]:
    """Greedy chunks: a section joins the open chunk unless that already holds more than its share of ``size`` tokens;
    a new chunk begins with the last ``overlap`` percent of the characters before it, which don't count."""
    limit = size * (100 - overlap) / 100
    chunks, counts = [""], [0]
    for section in sections:
        piece = "\n" + section
        n = count_tokens(piece)
        if chunks[-1] == "" or counts[-1] > limit:
            tail = chunks[-1][int(len(chunks[-1]) * (100 - overlap) / 100) :] if overlap else ""
            chunks.append(tail + piece)
            counts.append(n)
        else:
            chunks[-1] += piece
            counts[-1] += n
    return chunks


def split_text(text: str, size: int, delimiters: str) -> list[str]:
    """Parts between delimiters, joined by line feeds until a chunk holds more than ``size`` tokens."""
    out, n = [], 0
    for part in re.split("[" + re.escape(delimiters) + "]", text):
        if not part.strip():
            continue
        if out and n <= size:
            out[-1] += "\n" + part
            n += count_tokens(part)
        else:
            out.append(part)
            n = count_tokens(part)
    return out


def merge_typed(items: list[tuple[str, str]], size: int) -> list[tuple[str, str]]:
    """Neighbouring texts merge up to ``size`` tokens; tables and images stand alone and break the run."""
    out: list[tuple[str, str]] = []
    n = 0
    for kind, text in items:
        if kind == "text" and out and out[-1][0] == "text" and n <= size:
            out[-1] = ("text", out[-1][1] + "\n" + text)
            n += count_tokens(text)
        else:
            out.append((kind, text))
            n = count_tokens(text)
    return out


def media_context(items: list[tuple[str, str]], budget: int) -> list[tuple[str, str]]:
    """Tables and images with sentences of the text before and after them, as many as fit ``budget`` tokens a side."""
    out = []
    for i, (kind, text) in enumerate(items):
        if kind == "text":
            out.append((kind, text))
            continue
        sides = []
        for step in (-1, 1):
            room, parts, j = budget, [], i + step
            while 0 <= j < len(items) and items[j][0] == "text" and room >= 0:
                sentences = re.findall(r"[^.!?。！？\n]*[.!?。！？\n]+|[^.!?。！？\n]+$", items[j][1])
                for s in sentences[::step]:
                    if (n := count_tokens(s)) > room:
                        room = -1
                        break
                    parts.append(s)
                    room -= n
                j += step
            sides.append("".join(parts[::step]))
        out.append((kind, sides[0] + text + sides[1]))
    return out


def heading_level(line: str, family: int) -> int:
    """The level of a heading (1 is the highest), 0 for body text."""
    line = line.strip()
    if family < 0 or any(re.match(p, line) for p in NO_HEADING):
        return 0
    return next((k for k, p in enumerate(HEADINGS[family], 1) if re.match(p, line)), 0)


def choose_family(lines: list[str]) -> int:
    """The family whose patterns fit the most lines, the first on ties, -1 if none fits."""
    hits = [sum(heading_level(x, k) > 0 for x in lines) for k in range(len(HEADINGS))]
    return hits.index(max(hits)) if max(hits) else -1


def outline_chunks(lines: list[str], depth: int) -> list[str]:
    """Bodies under the headings above them, down to ``depth`` levels; a heading without a body gives its own path."""
    family = choose_family(lines)
    path: dict[int, str] = {}
    out: list[str] = []
    body: list[str] = []
    fresh = False

    def close() -> None:
        nonlocal body, fresh
        if body or fresh:
            out.append("\n".join([*(path[k] for k in sorted(path)), *body]))
        body, fresh = [], False

    for line in lines:
        level = heading_level(line, family)
        if 0 < level <= depth:
            deeper = fresh and not body and path and level > max(path)
            if not deeper:
                close()
            path = {k: v for k, v in path.items() if k < level} | {level: line}
            fresh = True
        elif line.strip():
            body.append(line)
    close()
    return out


def tree_chunks(lines: list[str], depth: int) -> list[str]:
    """A chunk per heading with none below it, under the headings above with their bodies; levels are those that occur."""
    family = choose_family(lines)
    if family < 0:
        return [x for x in lines if x.strip()]
    rows = []
    for x in lines:
        x = x.replace("　", " ").strip()
        said = x.split("@")[0].strip()
        if len(said) > 1 and not re.fullmatch("[0-9]+", said):
            rows.append((next((k for k, p in enumerate(HEADINGS[family], 1) if re.match(p, x)), 0), x))
    levels = sorted({k for k, _ in rows if k})[:depth]
    parts: list[tuple[int, list[str]]] = []
    for k, x in rows:
        if k in levels or not parts:
            parts.append((k if k in levels else 0, [x]))
        else:
            parts[-1][1].append(x)
    out, open_ = [], []
    for n, (k, body) in enumerate(parts):
        open_ = [p for p in open_ if 0 < p[0] < k] + [(k, body)]
        if k == 0 or n + 1 == len(parts) or parts[n + 1][0] <= k:
            out.append("\n".join(x for _, b in open_ for x in b))
    return out


def hierarchical_chunks(lines: list[str], depth: int, small: int = 218) -> list[str]:
    """Each line under the nearest headings above it; neighbours of one line are packed below ``small`` tokens."""
    out: list[str] = []
    n = small
    for c in outline_chunks(lines, depth):
        if "\n" not in c and out and n + count_tokens(c) < small:
            out[-1] += "\n" + c
            n += count_tokens(c)
        else:
            out.append(c)
            n = count_tokens(c) if "\n" not in c else small
    return out


def drop_contents(lines: list[str], reach: int = 128) -> list[str]:
    """Without tables of contents, heading by heading."""
    text = "\n".join(lines)
    english = len(re.findall(r"""[`a-zA-Z0-9\s.,':;/"?<>!()-]""", text)) / max(len(text), 1) > 0.8
    out, i = [], 0
    while i < len(lines):
        if not re.fullmatch("contents|目录|目次|tableofcontents|致谢|acknowledge(ments)?", re.sub(r"[ 　\t\r]+", "", lines[i]).lower()):
            out.append(lines[i])
            i += 1
            continue
        entry = next((k for k in range(i + 1, len(lines)) if lines[k].strip()), None)
        if entry is None:
            break
        head = " ".join(lines[entry].split()[:2]) if english else lines[entry].strip()[:3]
        i = next((k for k in range(entry + 1, min(entry + 1 + reach, len(lines))) if lines[k].strip().startswith(head)), entry + 1)
    return out


def markdown_blocks(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, first line, last line, text): header, code, list, quote or paragraph."""
    lines, out, i = text.split("\n"), [], 0
    kinds = (("header", r"#{1,6} "), ("list", r"\s*([-*+]|\d+\.) "), ("quote", r"\s*>"))
    kind_of = lambda x: next((k for k, p in kinds if re.match(p, x)), "paragraph")
    while i < len(lines):
        if not lines[i].strip():
            i += 1
            continue
        start = i
        if lines[i].lstrip().startswith("```"):
            i += 1
            while i < len(lines) and not lines[i].lstrip().startswith("```"):
                i += 1
            kind, i = "code", min(i + 1, len(lines))
        else:
            kind = kind_of(lines[i])
            i += 1
            while kind != "header" and i < len(lines) and lines[i].strip() and not lines[i].lstrip().startswith("```"):
                if kind_of(lines[i]) != kind and not (kind == "list" and lines[i].startswith((" ", "\t"))):
                    break
                i += 1
        out.append((kind, start, i - 1, "\n".join(lines[start:i])))
    return out


def markdown_qa(text: str) -> list[tuple[str, str]]:
    """(stacked headings, the body below them)."""
    stack: dict[int, str] = {}
    out, body, fenced = [], [], False

    def close() -> None:
        if stack and "\n".join(body).strip():
            out.append(("\n".join(stack[k] for k in sorted(stack)), "\n".join(body).strip()))
        body.clear()

    for line in text.split("\n"):
        fenced ^= line.lstrip().startswith("```")
        m = None if fenced else re.match(r"(#{1,6}) +(.*)", line)
        if m:
            close()
            level = len(m[1])
            stack = {k: v for k, v in stack.items() if k < level} | {level: m[2].strip()}
        else:
            body.append(line)
    close()
    return out


#: HTML elements.
BLOCKS = {"p", "div", "article", "section", "header", "footer", "main", "aside", "nav", "li", "ul", "ol", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "body", "dl", "dt", "dd", "form", "figure"}
SKIPPED = {"script", "style", "head", "noscript", "template", "iframe", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Blocks(HTMLParser):
    """Block texts in order; headings with their signs, tables whole."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.parts: list[str] = []
        self.skip = self.table = 0
        self.raw: list[str] = []
        self.sign, self.title, self.in_title = "", "", False

    def close_block(self) -> None:
        text = " ".join(" ".join(self.parts).split())
        if text:
            self.out.append(("text", self.sign + text))
        self.parts, self.sign = [], ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.in_title = self.in_title or tag == "title"
        if tag in SKIPPED:
            self.skip += 1
        elif self.table or tag == "table":
            if not self.table:
                self.close_block()
            self.table += tag == "table"
            self.raw.append(f"<{tag}>")
        elif tag in BLOCKS:
            self.close_block()
            if re.fullmatch("h[1-6]", tag):
                self.sign = "#" * int(tag[1]) + " "

    def handle_endtag(self, tag: str) -> None:
        self.in_title = self.in_title and tag != "title"
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif self.table:
            self.raw.append(f"</{tag}>")
            self.table -= tag == "table"
            if not self.table:
                self.out.append(("table", "".join(self.raw)))
                self.raw = []
        elif tag in BLOCKS:
            self.close_block()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip:
            (self.raw if self.table else self.parts).append(data.strip() if self.table else data)


def html_blocks(html: str) -> tuple[str, list[tuple[str, str]]]:
    """(title, blocks)."""
    p = _Blocks()
    p.feed(html)
    p.close()
    if p.raw:
        p.out.append(("table", "".join(p.raw)))
    p.close_block()
    return " ".join(p.title.split()), p.out


def html_chunks(html: str, size: int) -> list[str]:
    """Blocks packed up to ``size`` tokens; tables whole; a block of more is cut every ``size`` tokens."""
    out: list[str] = []
    n = size + 1
    for kind, text in html_blocks(html)[1]:
        m = count_tokens(text)
        if kind == "table":
            out.append(text)
            n = size + 1
        elif m > size:
            at = [x.start() for x in _TOKEN.finditer(text)][::size] + [len(text)]
            out += [text[a:b] for a, b in zip(at, at[1:], strict=False)]
            n = size + 1
        elif n + m <= size:
            out[-1] += "\n" + text
            n += m
        else:
            out.append(text)
            n = m
    return out


def html_to_text(html: str) -> tuple[str, str]:
    """(title, text): list items behind dashes, cells behind tabs, rows and blocks on lines of their own."""
    title, blocks = html_blocks(re.sub(r"(?i)<li[^>]*>", "<li>- ", html))
    lines = []
    for kind, text in blocks:
        if kind == "table":
            text = re.sub(r"</t[dh]>", "\t", re.sub(r"</tr>", "\n", text))
            text = re.sub(r"<[^>]+>", "", text)
        lines.append(re.sub("[​‌‍﻿]", "", text).strip())
    return title, re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \xa0]+", " ", "\n".join(lines))).strip()


def pack_windows(texts: list[str], most: int) -> list[str]:
    """Chunks in order, joined while their tokens stay under ``most``."""
    out: list[str] = []
    n = 0
    for t in texts:
        m = count_tokens(t)
        if out and n + m < most:
            out[-1] += t
            n += m
        else:
            out.append(t)
            n = m
    return out
