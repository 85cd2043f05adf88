"""Main text of web pages by templates deduced from pages of the same host.

Tags (with the way from the root) and whole text blocks are the tokens of a page. Tokens
that occur equally often on every page of a host share an occurrence vector and form an
equivalence class. Classes with enough tokens and pages make up the host's template. On
a page, a class is valid if its tokens come in the template's order, turn by turn, and the
valid classes nest: what lies between their tags are slots. Which slots are the article
is told by the names of elements (``article``, ``main``), since menus and footers have
slots of their own. A block that belongs to the template itself (the same text on nearly all
pages, its class valid on this one) is no slot. An article loses such blocks before and
behind its own text only, so what pages share in the middle of their text stays, and an
article of nothing else stays whole.

Elements whose tag says that they are menus, headers, footers, sidebars or forms are left
out, as are scripts, styles and markup, and elements that have the attribute ``hidden``.
Containers that a whole class, an id or a role names as such (``sidebar``, ``cookie-notice``,
not ``has-sidebar``) are left out, too, but no heading is, and no name speaks about an article
that isn't inside another: where a page's only article stands in a form or a container so
named, it is the article.

A vector is kept as the exclusive or of a hash of (page, count), so a host's pages are
never gathered: tokens are summed by (host, token), then by (host, vector). Every token
of a page counts. Each token of a host's template is on at least a share of ``SUPPORT`` of
the pages, so a template has at most the mean number of different tokens of a page, divided
by ``SUPPORT``. A host with too few pages has no template, and its pages are read by their
own structure.

Defined cases: a null or empty html gives an empty text; a null url has the host ''.
Repeated pages give repeated rows and count once for the template. Unclosed elements end
with their parent; broken tags are text. Further columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.base import lean, stash
from cardwatch.llm.url_filter import HOST

LEAST_PAGES = 3
SUPPORT = 0.3
CLASS_TOKENS = 2
NEARLY_ALL = 0.9
# Rows of one batch of page tokens, so that long pages don't add up.
TOKEN_ROWS = 50_000

# Names of elements and of the parts they mark.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
RAW = frozenset("script style noscript template iframe textarea svg math object canvas select option button".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
LEFT_OUT = frozenset("head title nav header footer aside form menu dialog search fieldset".split())
LEFT_OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs header masthead footer sidebar aside widget related recommended cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe signup login comment comments reply replies discussion disqus share sharing "
    "social toolbar pagination banner contentinfo complementary search dialog alert form".split()
)
ARTICLE = frozenset(("article", "main"))
# Elements that end where another of these begins.
ENDED_BY = {
    "p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "tr": frozenset(("tr",)),
}

# A tag ends at the first > outside quotes, or, where its quotes don't close in time, at the first of all.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]{0,4096}"|'[^']{0,4096}')*+)>""")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Elements whose class, id or role says nothing about what they are.
NAMELESS = frozenset("html body article main h1 h2 h3 h4 h5 h6 p".split())
# How far a part is left out: not, by a name or a form around it (an article inside is none the less), for good.
KEPT, NAMED, GONE = 0, 1, 2
# Whether a part is in no article, in one, or in one that a named part holds.
OUTSIDE, ARTICLE_PART, NAMED_ARTICLE = 0, 1, 2


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _names(attributes: dict[str, str]) -> set[str]:
    """Whole classes, the id and the role, lower-cased."""
    return {name for a in ("class", "id", "role") for name in attributes.get(a, "").lower().split()}


def _is_left_out(name: str) -> bool:
    """All words of the name are listed; numbers don't matter."""
    words = [w for w in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])", name) if w and not w.isdigit()]
    return bool(words) and all(w in LEFT_OUT_NAMES for w in words)


def read_page(html: str | None) -> list[tuple]:
    """The page in order: ('open' or 'close' or 'text', way, element or text, left out, in article).

    way: hash of the elements from the root. Text is one block, references decoded and white
    space made single. What is left out (KEPT, NAMED, GONE) and in an article (OUTSIDE,
    ARTICLE_PART, NAMED_ARTICLE) holds for the inside of an element.
    """
    out: list[tuple] = []
    stack: list[tuple[str, int, int, int]] = [("", 0, KEPT, OUTSIDE)]
    pieces: list[str] = []

    def end_block():
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                out.append(("text", stack[-1][1], text, stack[-1][2], stack[-1][3]))

    def pop():
        end_block()
        name, way, gone, article = stack.pop()
        n_open[name] -= 1
        out.append(("close", way, name, gone, article))

    at, html, n_open = 0, html or "", Counter()
    last = html.rfind(">")
    while at < len(html):
        if at > last:
            pieces.append(references.unescape(html[at:]))
            break
        m = _TAG.match(html, at) or _OTHER.match(html, at)
        at = m.end()
        name = m[2]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                pieces.append(references.unescape(m[0]) if "&" in m[0] else m[0])
            continue
        name = name.lower()
        if name in RAW:
            if not m[1] and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            pieces.append(" ")
            continue
        if name not in BLOCKS:
            if name == "br" or name in VOID:
                pieces.append(" ")
            continue
        end_block()
        if m[1]:
            if n_open[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        while len(stack) > 1 and name in ENDED_BY.get(stack[-1][0], ()):
            pop()
        attributes = _attributes(m[3]) if m[3] else {}
        names = _names(attributes)
        way = xxhash.xxh3_64_intdigest(f"{stack[-1][1]}/{name}.{' '.join(sorted(names))}") >> 1
        gone, article = stack[-1][2], stack[-1][3]
        if name in ARTICLE and article == OUTSIDE and gone != GONE:
            article, gone = (NAMED_ARTICLE if gone == NAMED else ARTICLE_PART), KEPT
        elif "hidden" in attributes or name in LEFT_OUT and name != "form":
            gone = GONE
        elif name == "form" or (name not in NAMELESS or article and name in ARTICLE) and any(map(_is_left_out, names)):
            gone = max(gone, GONE if article else NAMED)
        if "hidden" in attributes:
            gone = GONE
        out.append(("open", way, name, gone, article))
        if name in VOID:
            out.append(("close", way, name, gone, article))
        else:
            stack.append((name, way, gone, article))
            n_open[name] += 1
    while len(stack) > 1:
        pop()
    end_block()
    return out


def token_of(item: tuple) -> int:
    """Tags by their way, text blocks by way and text."""
    return xxhash.xxh3_64_intdigest(f"{item[0]} {item[1]} {item[2]}") >> 1


def valid_tokens(items: list[tuple], template: dict[int, tuple[int, int]]) -> set[int]:
    """Template tokens of the classes whose tokens come in order, turn by turn, on this page.

    template: token -> (class, place in its class).
    """
    turns: dict[int, list[int]] = {}
    members: dict[int, list[int]] = {}
    for token, (k, _) in template.items():
        members.setdefault(k, []).append(token)
    tokens = [token_of(i) for i in items]
    for token in tokens:
        if token in template:
            k, place = template[token]
            turns.setdefault(k, []).append(place)
    valid: set[int] = set()
    for k, places in turns.items():
        # In order from the first: each turn of a class goes through its places once.
        if len(places) % len(members[k]) == 0 and all(p == i % len(members[k]) for i, p in enumerate(places)):
            valid.update(members[k])
    return valid


def slots(items: list[tuple], valid: set[int] | None) -> list[tuple[int, list[tuple]]]:
    """(which article part, text items) of what lies between the template's tags, without what is left out.

    valid: the template tokens of the page; None takes every tag for one.
    """
    out: list[tuple[int, list[tuple]]] = []
    # One entry for each open element; those that aren't the template's hold what is around them.
    around = [(KEPT, OUTSIDE)]
    for item in items:
        kind, _, _, gone, article = item
        if kind == "text":
            if not gone and not around[-1][0]:
                if not out or out[-1][0] != (article or around[-1][1]):
                    out.append((article or around[-1][1], []))
                out[-1][1].append(item)
            continue
        known = valid is None or token_of(item) in valid
        if kind == "open":
            around.append((gone, article) if known else around[-1])
        else:
            around.pop()
        if known:
            out.append((around[-1][1], []))
    return out


def _without_frame(texts: list[tuple], known: frozenset[int] | set[int]) -> list[tuple]:
    """The blocks from the first to the last that isn't known; all if every block is."""
    own = [k for k, item in enumerate(texts) if token_of(item) not in known]
    return texts[own[0] : own[-1] + 1] if own else texts


def main_text(html: str | None, template: dict[int, tuple[int, int]], constant: frozenset[int]) -> str:
    """The article's slots, without an article all slots, but for blocks of the host's template.

    constant: the template's blocks of text that are on nearly all pages.
    """
    items = read_page(html)
    valid = valid_tokens(items, template)
    found = slots(items, valid or None)
    for part in (ARTICLE_PART, NAMED_ARTICLE):
        whole = [i for article, texts in found if article == part for i in texts]
        if whole:
            return "\n\n".join(i[2] for i in _without_frame(whole, constant & valid))
    return "\n\n".join(i[2] for _, texts in found for i in texts if token_of(i) not in constant)


@lean
def _page_tokens(batches):
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def batch_of(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "page", "token", "n", "place"])

    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        for host, page, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            counts: dict[int, list] = {}
            for place, item in enumerate(read_page(html)):
                token = token_of(item)
                if token in counts:
                    counts[token][0] += 1
                else:
                    counts[token] = [1, place, item[0] == "text"]
            for token, (n, place, is_text) in counts.items():
                for column, value in zip(columns, (host, page, token, n, place if not is_text else -1 - place), strict=True):
                    column.append(value)
            if len(columns[0]) >= TOKEN_ROWS:
                yield batch_of(columns)
                columns = [[], [], [], [], []]
        yield batch_of(columns)


def templates(pages: DataFrame) -> DataFrame:
    """host, tokens (token, class, place in the class, constant) of every host with enough pages.

    pages: host, page, html.
    """
    tokens = pages.mapInArrow(_page_tokens, "host string, page long, token long, n long, place long")
    # Repeated pages fold here, where no html has to move.
    tokens = tokens.groupBy("host", "page", "token").agg(F.max("n").alias("n"), F.min("place").alias("place"))
    sizes = pages.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    vectors = tokens.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count(F.lit(1)).alias("on"), F.avg("n").alias("times"),
        F.avg(F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))).alias("place"), F.min(F.col("place") < 0).alias("is_text"),
    )
    frequent = vectors.join(sizes, "host").where(F.col("on") >= F.greatest(F.lit(LEAST_PAGES), F.ceil(SUPPORT * F.col("pages"))))
    classes = frequent.groupBy("host", "vector", "on", "pages").agg(
        F.array_sort(F.collect_list(F.struct("place", "token", "is_text"))).alias("members")
    ).where(F.size("members") >= CLASS_TOKENS)
    each = classes.select("host", "vector", "on", "pages", F.posexplode("members").alias("at", "m")).select(
        "host",
        F.struct(
            F.col("m.token").alias("token"), F.col("vector").alias("of_class"), F.col("at").cast("long").alias("place"),
            (F.col("m.is_text") & (F.col("on") >= NEARLY_ALL * F.col("pages"))).alias("constant"),
        ).alias("t"),
    )
    return each.groupBy("host").agg(F.collect_list("t").alias("tokens"))


@lean
def _extract(batches):
    ready: dict = {}
    for batch in batches:
        texts = []
        for host, html, tokens in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
            if host not in ready:
                if len(ready) > 64:
                    ready.clear()
                known = tokens.as_py() or []
                ready[host] = (
                    {t["token"]: (t["of_class"], t["place"]) for t in known}, frozenset(t["token"] for t in known if t["constant"]),
                )
            texts.append(main_text(html, *ready[host]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    own = own.withColumn("host", F.expr(f"coalesce({HOST}, '')"))
    # Written first: its size is then known, and the join broadcasts it only if it is small.
    found = stash(templates(own.select("host", F.col("page_id").alias("page"), "html")), "templates")
    return own.join(found, "host", "left").select("page_id", "url", "host", "html", "tokens").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )
