"""Operator 10: main text of web pages by block rules in two passes.

Markup is scanned once into blocks of text, each with its length, share of stop words, share of text in
links, and what the elements around it say: "bad" in menus, headers, footers, sidebars, notices, adverts,
forms and comments, "main" in an article or main part. An article in a bad part (a teaser in a sidebar) is no
main part; it counts as one only where a page has no other content.

Both passes run on every page. First pass: blocks that are bad or mostly links are boilerplate (but a linked
heading in a main part is undecided); others are content by length and stop-word density, where a main part
asks for fewer stop words, or stay undecided. If the main parts hold more letters than the content outside
them, blocks outside must be long, dense in stop words and without links. Second pass: undecided blocks take the label of the nearest decided
neighbours: content if either nearest one is, unless the block reads like boilerplate; headings follow what
comes after. In a main part only its blocks are neighbours, and with none decided a block is content.
"""

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# Frequent words of four languages, as jusText-like rules use them.
STOP_WORDS = {
    "en": "the of and a to in is was it for on that by this with you be are not have as at from or but an they which we all he she his her their has had were been what there".split(),
    "de": "der die das und in zu den ist von mit sich des auf für im dem nicht ein eine als auch es an er so dass sie nach bei um am wie aus war wird einer zum zur".split(),
    "fr": "le la les de des et un une du en est que qui dans pour par sur au pas plus ne se ce il elle avec son sa aux ou comme mais nous vous ils sont été".split(),
    "es": "el la los las de y en que un una es por con para se del al lo no su más como pero sus le ya este entre porque muy sin sobre también me hasta hay".split(),
}
# Element names by role.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav footer aside form button select textarea fieldset dialog menu datalist iframe object audio video canvas map".split())
MAIN = frozenset("article main".split())
BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|sidebar|side|aside|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|topbar|footer|copyright|legal|comments?|disqus|replies|respond|share|sharing|social|related|recommend\w*|recirc\w*|widget|login|signup|search|pagination|pager|toc|tags|meta|byline)(?:$|[\s_-])",
    re.I,
)
OWN_NAME = re.compile(r"(?:^|[\s_-])(?:header|masthead|legal)(?:$|[\s_-])", re.I)  # an article's own head, or a text about law
BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|respond)(?:$|[\s_-])", re.I)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|math|xmp|noframes|noembed)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

MAX_LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.33, 70, 200, 0.12, 0.2


def names_of(attributes: str) -> tuple[str, str, bool]:
    """(class and id, role, hidden)."""
    got = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(attributes)}
    hidden = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""), re.I) is not None
    return f"{got.get('class', '')} {got.get('id', '')}".strip(), got.get("role", "").lower(), hidden


def blocks_of(page: str) -> list[dict]:
    """Blocks in page order: text, letters in links, where ("bad", "main", "teaser": an article in a bad part, or "")."""
    blocks: list[dict] = []
    stack: list[tuple[str, str, bool, bool]] = []  # element, where, in a main part, in comments or hidden
    parts: list[tuple[str, bool]] = []
    links = at = 0

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(p for p, _ in parts)).split())
            if text:
                linked = len(" ".join(entities.unescape(" ".join(p for p, l in parts if l)).split()))
                blocks.append({"text": text, "linked": min(linked, len(text)), "where": stack[-1][1] if stack else "", "tag": stack[-1][0] if stack else ""})
            parts.clear()

    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        if m[0].startswith("<![CDATA["):
            parts.append((entities.escape(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:]), links > 0))
            continue
        if m[3] is None:
            continue
        closes, tag, attributes = bool(m[2]), m[3].lower(), m[4] or ""
        if tag == "br":
            parts.append((" ", links > 0))
            continue
        if tag == "a":
            links = max(0, links - 1) if closes else links + 1
        if tag in INLINE:
            if not attributes or closes or tag in VOID:
                continue
            _, _, hidden = names_of(attributes) if "hidden" in attributes or "none" in attributes else ("", "", False)
            if not hidden:
                continue
        flush()
        if tag not in INLINE:
            links = links if tag == "a" else 0
        if closes:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in VOID:
            continue
        _, where, in_main, in_comments = stack[-1] if stack else ("", "", False, False)
        named, role, hidden = names_of(attributes) if attributes.strip() else ("", "", False)
        in_comments = in_comments or hidden or bool(COMMENTS.search(named))
        told = OWN_NAME.sub(" ", named) if in_main and not in_comments else named
        bad = tag in DROPPED or hidden or role in BAD_ROLE or (BAD_NAME.search(told) is not None and tag not in ("body", "html") and not (tag in MAIN and not in_comments))
        if tag == "header" and not in_main:
            bad = True
        if tag in MAIN or role in ("main", "article"):
            whole = tag == "main" or role == "main"
            if in_comments:
                where = "bad"
            elif whole or where in ("", "main"):
                where = "main"
            elif not in_main:
                where = "teaser"
            in_main = in_main or where == "main"
        elif tag == "body":
            where = ""
        elif bad:
            where = "bad"
        if attributes.endswith("/") and tag not in ("p", "div", "li"):
            continue
        if tag == "p" and stack and stack[-1][0] == "p":
            stack.pop()  # a paragraph ends where the next begins
            where = where if bad or tag in MAIN else (stack[-1][1] if stack else "")
        stack.append((tag, where, in_main, in_comments))
    if at < len(page):
        parts.append((page[at:], links > 0))
    flush()
    return blocks


def stop_share(words: list[str], stop: frozenset) -> float:
    return sum(w in stop for w in words) / len(words) if words else 0.0


STOP_SETS = {k: frozenset(v) for k, v in STOP_WORDS.items()}


def decided_around(labels: list[bool | None]) -> tuple[list[bool | None], list[bool | None]]:
    """The nearest decided label before each place, and after it."""
    before, after = [], []
    for out, row in ((before, labels), (after, labels[::-1])):
        last = None
        for x in row:
            out.append(last)
            last = last if x is None else x
    return before, after[::-1]


def labels_of(blocks: list[dict], main: tuple[str, ...] = ("main",)) -> list[bool]:
    """Whether each block is content, by both passes; blocks with a `where` of `main` are in a main part."""
    words = [re.findall(r"\w+", b["text"].lower()) for b in blocks]
    inside = [b["where"] in main for b in blocks]
    bad = [b["where"] != "" and not i for b, i in zip(blocks, inside, strict=True)]
    heading = [re.fullmatch(r"h[1-6]", b["tag"]) is not None for b in blocks]
    every = [w for ws, x in zip(words, bad, strict=True) if not x for w in ws]
    stop = max(STOP_SETS.values(), key=lambda s: stop_share(every, s))
    sizes, shares, links = [len(b["text"]) for b in blocks], [stop_share(ws, stop) for ws in words], [b["linked"] / len(b["text"]) for b in blocks]
    first: list[bool | None] = []
    for k, b in enumerate(blocks):
        n, share = sizes[k], shares[k]
        if bad[k] or (links[k] > MAX_LINKS and not (inside[k] and heading[k])) or ("©" in b["text"][:200] and not (inside[k] and n >= LONG)):
            first.append(False)
        elif links[k] <= MAX_LINKS and (n >= SHORT and share >= (STOP_LOW if inside[k] else STOP_HIGH) or n >= LONG and (share >= STOP_LOW or links[k] == 0)):
            first.append(True)
        else:
            first.append(None)
    if sum(n for n, i, x in zip(sizes, inside, first, strict=True) if i and x is not False) > sum(n for n, i, x in zip(sizes, inside, first, strict=True) if not i and x):
        first = [x if i else bool(x and n >= LONG and share >= STOP_HIGH and l == 0) for x, i, n, share, l in zip(first, inside, sizes, shares, links, strict=True)]
    labels = list(first)
    nearest = {False: decided_around(first), True: decided_around([x if i else None for x, i in zip(first, inside, strict=True)])}
    for k, label in enumerate(first):
        if label is None:
            near = nearest[inside[k]]
            before, after = near[0][k], near[1][k]
            alone = before is None and after is None
            labels[k] = bool(after if heading[k] and after is not None else alone or (before and after) or ((before or after) and blocks[k]["linked"] == 0))
    return labels


def main_text(page: str) -> str:
    """The blocks of the main text, joined by one line end; empty if there is none."""
    blocks = blocks_of(page)
    labels = labels_of(blocks)
    if not any(labels) and any(b["where"] == "teaser" for b in blocks):
        labels = labels_of(blocks, ("main", "teaser"))
    return "\n".join(b["text"] for b, label in zip(blocks, labels, strict=True) if label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages (page_id, url, html); null or empty html: empty text. No shuffle.

    Repeated rows and ids each have their row; an empty table gives none. Time and memory are in proportion to a page's length, however long.
    """
    C.small_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) if x else "" for x in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(C.tidied(work), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
