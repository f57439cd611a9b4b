"""HTML as leaf blocks: runs of text between block-level tags, with features of their ancestors and of their text.

A tolerant reader, linear in the page: comments, declarations and raw text go; block-level start tags end open paragraphs, items,
cells and rows; unmatched end tags are passed over; an end of page inside a tag ends the page. ``br`` is white space. Character
references are decoded, white space (Unicode's) in a block becomes single spaces, empty blocks are none.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from dataclasses import dataclass, field

#: Elements that begin a block, that hold raw text, and whose content is no text of the page.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style title textarea iframe noembed noframes noscript xmp".split())
HIDDEN = frozenset("audio button canvas datalist map math object optgroup option select svg template video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag ends if it is open, and the elements beyond which it does not look.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
BARRIERS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "td": ("table", "tr"), "th": ("table", "tr"), "tr": ("table",), "option": ("select", "datalist")}
TAG = re.compile(r"<([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
END = re.compile(r"</([A-Za-z][^\s/>]*)")
RAW_END = {n: re.compile(rf"(?i)</{n}(?=[\s/>])") for n in RAW}
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Open elements, from the innermost, whose class and id words count.
NEAREST = 12
#: The attribute by which labelled pages say what is main text (1) and what is not (0), for an element and what it holds.
LABEL = "data-label"


@dataclass
class Block:
    text: str
    #: Names of features that do not depend on the other blocks.
    features: list[str]
    #: 1 or 0 in labelled pages, else None.
    truth: int | None
    link_share: float = 0.0
    tags: tuple[str, ...] = field(default=(), repr=False)


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks in order, with features (see :func:`_own` and :func:`_among`)."""
    blocks, seen = [], set()
    stack: list[tuple[str, tuple[str, ...], int | None]] = []  # name, words of class, id and role, label
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    state: list = [None, 0, 0]  # what held when the block began; characters in links, and in all

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            blocks.append(_own(text, *state[0], state[1] / max(state[2], 1)))
        pieces.clear()
        state[:] = [None, 0, 0]

    def add(raw: str) -> None:
        if not raw or any(opened[h] for h in HIDDEN if h in opened):
            return
        text = entities.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        n = len(text) - text.count(" ")
        state[1] += n if opened["a"] else 0
        state[2] += n
        if state[0] is None and not text.isspace():
            near = tuple(dict.fromkeys(w for e in reversed(stack[-NEAREST:]) for w in e[1]))
            truth = next((e[2] for e in reversed(stack) if e[2] is not None), None) if labelled else None
            holders = [e[0] for e in stack[-NEAREST:] if e[0] in BLOCK]
            own = next((e[1] for e in reversed(stack[-NEAREST:]) if e[1]), ())
            state[0] = ([t for t, n in opened.items() if n], near, own, holders[-2:], truth)

    def pop() -> None:
        name = stack.pop()[0]
        opened[name] -= 1
        if not opened[name]:
            del opened[name]
        if name in BLOCK:
            flush()

    def close(names: tuple[str, ...], barriers: tuple[str, ...]) -> None:
        if not any(opened.get(n) for n in names):
            return
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in names:
                while len(stack) > at:
                    pop()
                return
            if stack[at][0] in barriers:
                return

    labelled = LABEL in page
    at, end = 0, len(page)
    while at < end:
        tag = page.find("<", at)
        if tag < 0:
            add(page[at:])
            break
        add(page[at:tag])
        after = page[tag + 1 : tag + 2]
        if page.startswith("<!--", tag):
            stop = page.find("-->", tag + 2)
            at = end if stop < 0 else stop + 3
        elif after in ("!", "?") and after:
            stop = page.find(">", tag)
            at = end if stop < 0 else stop + 1
        elif after == "/" and (m := END.match(page, tag)):
            stop = page.find(">", m.end())
            at, name = end if stop < 0 else stop + 1, m[1].lower()
            if name in BLOCK:
                flush()
                close((name,), ())
            elif opened.get(name):
                close((name,), tuple(BLOCK))  # an inline element that a block was opened in stays open with it
        elif after.isascii() and after.isalpha():
            m = TAG.match(page, tag)
            stop = m.end() - 1 if m else page.find(">", tag)
            if stop < 0:
                break
            at = stop + 1
            name, rest = (m[1].lower(), m[2]) if m else (re.match(r"[^\s/>]*", page[tag + 1 : tag + 40])[0].lower(), "")
            seen.add(name)
            if name in RAW:
                closing = RAW_END[name].search(page, at)
                at = closing.start() if closing else end
                continue
            if name in BLOCK:
                flush()
                if opened.get("p"):
                    close(("p",), tuple(BLOCK - {"p"}))
            if name in ENDS:
                close(ENDS[name], BARRIERS[name])
            if name == "br":
                add(" ")
            if name in VOID or rest.endswith("/") and name not in BLOCK:
                continue
            words, label = [], None
            for key, *values in ATTRIBUTE.findall(rest):
                value = next((v for v in values if v), "")
                if key.lower() == LABEL:
                    label = int(value == "1")
                else:
                    words += [w.lower() for w in NAME_WORD.findall(value)]
            stack.append((name, tuple(words[:40]), label))
            opened[name] += 1
        else:
            add("<")
            at = tag + 1
    flush()
    _among(blocks, seen)
    return blocks


def _bucket(n: int) -> int:
    return min(int(math.log2(n + 1)), 12)


def _own(text: str, tags: list[str], words: tuple[str, ...], own: tuple[str, ...], holders: list[str], truth: int | None, link_share: float) -> Block:
    """Features of the ancestors (tags, words of all near ones' classes and of the innermost that has any, holders) and of the text (size, marks, links)."""
    parts = text.split(" ")
    capitals = sum(p[:1].isupper() for p in parts) / len(parts)
    f = ["bias", *(f"tag:{t}" for t in tags), *(f"word:{w}" for w in words), *(f"own:{w}" for w in own), f"in:{'>'.join(holders)}", f"holder:{holders[-1] if holders else ''}"]
    f += [f"chars:{_bucket(len(text))}", f"words:{_bucket(len(parts))}", f"links:{0 if link_share == 0 else 1 if link_share < 0.34 else 2 if link_share < 0.75 else 3}", f"commas:{min(text.count(','), 3)}", f"capitals:{int(capitals * 3)}"]
    f += [n for n, has in (("ends", text[-1] in ".!?…\"'»”’。！？"), ("copyright", "©" in text), ("bars", " | " in text or "»" in text), ("digits", sum(c.isdigit() for c in text[:400]) * 5 > min(len(text), 400)), ("long", len(parts) >= 15)) if has]
    return Block(text, f, truth, link_share, tuple(tags))


def _among(blocks: list[Block], seen: set[str]) -> None:
    """Features that come from the page: article elements elsewhere, the place on the page, the neighbours' size, links and holders."""
    first = [b.features[:] for b in blocks]
    find = lambda f, kind: next((x for x in f if x.startswith(kind)), "")
    for i, b in enumerate(blocks):
        b.features += [f"elsewhere:{t}" for t in ("article", "main") if t in seen and t not in b.tags]
        b.features.append(f"place:{10 * i // len(blocks)}")
        for side, j in (("before", i - 1), ("after", i + 1)):
            if 0 <= j < len(blocks):
                b.features += [f"{side}:{find(first[j], kind)}" for kind in ("words:", "links:", "holder:")]
                b.features.append(f"{side}-alike:{find(first[j], 'in:') == find(first[i], 'in:')}")
            else:
                b.features.append(f"{side}:none")
