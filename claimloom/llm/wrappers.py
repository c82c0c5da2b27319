"""Main-text extraction by wrappers inferred from the pages of a host.

A page is a stream of structural tags and text slots; inline markup belongs to the text around it.
For every host a union-free regular expression is inferred: starting from one page it is aligned
with one more page after another. Equal tags match; runs of like siblings, and runs of like groups
of siblings, become repeated groups; what only some pages have becomes optional; texts become slots.

What a slot is follows from the texts that all pages of the host have in it: their length, how much
of it is link text, and whether it is the template's, the one text that SHARE of the host's
different pages (LEAST at the fewest) have there. From the top, the content is looked for in the one
child that holds DOMINANT of the running text, until it is spread over several; there is the host's
article, and what stands beside it is not content. Lists of links are none, nor are elements that
their tags or names call menus, adverts, comments and the like, unless they hold nearly all of the
host's text or its article. A tag article or main is the content where the texts leave it open. A
page is matched against its host's wrapper and takes each block's role from the slot it falls on.
Pages that have the same texts outside named boilerplate are copies and count once.

All pages of a host are aligned and counted. Aligning takes each folded shape once, in SALTS groups
by hash and then group by group, in an order that depends on the shapes only. Texts are counted by
their hashes and lengths, so no host is in one place. Models are broadcast while they have under
BROADCAST bytes altogether and joined by host beyond.

Defined cases: null and empty pages have empty text; truncated markup is closed where it ends; very
long pages are read whole, very long rows of siblings aligned greedily; pages without a host share
one wrapper; repeated rows repeat; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import pickle
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, bytes_of
from .urls import host_and_path

SALTS, BROADCAST = 64, 16_000_000
SHARE, LEAST = 0.9, 3
#: Of an element's running text: what one child must hold to be where the content is, and what a named one must hold not to be boilerplate.
DOMINANT, NEARLY_ALL = 0.75, 0.85
#: Of an element's text: what links make up in a list of links.
LINKED = 0.8
#: Elements nested deeper are read as part of the one around them.
DEPTH = 100
#: Pairs of siblings that are aligned by a longest common subsequence.
PAIRS = 250_000
SCHEMA = "page_id long, url string, text string, n_chars long"

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup or no text of the page.
RAW = frozenset("script style textarea title noscript template iframe svg math canvas object select".split())
#: Those of them that run to the end of the page if they are not closed.
ENDLESS = frozenset("script style textarea title template".split())
#: A start tag that closes an open element of these kinds, up to the list, table or section it is in.
CLOSES = {"option": ("option",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl table article section div body main nav aside".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form head menu dialog button label fieldset option optgroup".split())
#: Elements that may hold an article; others are parts of it.
CONTAINERS = frozenset("html body div article main section center".split())
_NAMED = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|banner|sidebar|side|menu|nav\w*|breadcrumbs?|footer|header|masthead|notices?|alert|cookies?|consent|gdpr|popup|modal|overlay|promo\w*|sponsor\w*|comments?|replies|reply|respond|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|form|widget|toolbar|pagination|pager|copyright|legal|skip)(?:$|[-_ ])"
)
_MAIN = re.compile(r"^(?:article|main)$")
_TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|([!?])|(/?)([a-zA-Z][^\s/>]*))", re.S)
_NEXT = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACES = re.compile(r"\s+")


def _tag_end(text: str, at: int) -> int:
    """Past the > that ends the tag, quoted ones aside; past the next > if a quote is never closed."""
    first = text.find(">", at)
    while (m := _NEXT.search(text, at)) and m[0] != ">":
        at = text.find(m[0], m.end()) + 1
        if not at:
            return first + 1 if first >= 0 else len(text)
    return m.end() if m else len(text)


def _key(tag: str, attributes: str) -> str:
    if "=" not in attributes:
        return tag
    named = sorted((m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in _ATTRIBUTE.finditer(attributes))
    return " ".join([tag, *(re.sub(r"\d+", "", v) for _, v in named)]) if named else tag


def stream(page: str) -> tuple[list[str], list[str], list[int]]:
    """Keys of a page's balanced structure ("<k", "/", "#"), the text of each block "#", and its characters in links."""
    keys: list[str] = []
    texts: list[str] = []
    linked: list[int] = []
    open_: list[str] = []
    held: list[str] = []
    hidden: list[str] = []  # inline elements whose text is none of the page's
    links = [0, 0]  # depth of links, characters in them since the block began

    def hold(raw: str) -> None:
        run = entities.unescape(raw)
        held.append(run)
        if links[0]:
            links[1] += len(run)

    def end_block() -> None:
        if held:
            text = _SPACES.sub(" ", "".join(held)).strip()
            held.clear()
            if text:
                keys.append("#")
                texts.append(text)
                linked.append(min(links[1], len(text)))
        links[1] = 0

    def close(n: int) -> None:
        end_block()
        keys.extend("/" * (len(open_) - n))
        del open_[n:]

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        if not hidden and end > at:
            hold(page[at:end])
        if not m:
            break
        if m[1] is not None:
            at = m.end()
            continue
        at = _tag_end(page, m.end())
        if m[2]:
            continue
        tag = m[4].lower()
        if m[3]:
            if tag in BLOCKS:
                if tag in open_:
                    hidden.clear()
                    links[0] = 0
                    close(len(open_) - 1 - open_[::-1].index(tag))
            elif tag in hidden:
                del hidden[len(hidden) - 1 - hidden[::-1].index(tag) :]
            elif tag == "a":
                links[0] = max(0, links[0] - 1)
            continue
        if tag in RAW:
            if page[at - 2 : at] != "/>":
                ended = re.compile(f"</{re.escape(tag)}\\b", re.I).search(page, at)
                at = _tag_end(page, ended.end()) if ended else size if tag in ENDLESS else at
            continue
        if tag == "br":
            held.append(" ")
            continue
        key = _key(tag, page[m.end() : at])
        if tag not in BLOCKS:
            if tag not in VOID and page[at - 2 : at] != "/>":
                if hidden or tag in BOILERPLATE_TAGS or " " in key and _NAMED.search(key.partition(" ")[2]):
                    hidden.append(tag)
                elif tag == "a":
                    links[0] = 1  # links do not nest
            continue
        hidden.clear()
        links[0] = 0
        if open_ and open_[-1] == "p":
            close(len(open_) - 1)
        for k in range(len(open_) - 1, -1, -1):
            if open_[k] in CLOSES.get(tag, ()):
                close(k)
                break
            if open_[k] in SCOPES:
                break
        end_block()
        if tag != "hr" and len(open_) < DEPTH:
            keys.append("<" + key)
            open_.append(tag)
    close(0)
    return keys, texts, linked


class Node:
    """A tag or a group of siblings in a wrapper or page, with its children; "#" is a text slot.

    A slot has a number; it is single if no page can have two texts in it.
    """

    __slots__ = ("key", "kids", "repeated", "optional", "slot", "single", "role", "places")

    def __init__(self, key: str, kids: list[Node] | None = None):
        self.key, self.kids, self.repeated, self.optional = key, kids if kids is not None else [], False, False
        self.slot, self.single, self.role = -1, False, ""
        self.places: tuple[list[Node], dict[str, list[int]]] | None = None

    def flat(self) -> tuple[list[Node], dict[str, list[int]]]:
        """Children, with those of groups in their place, and where each key stands among them."""
        if self.places is None:
            kids: list[Node] = []
            for kid in self.kids:
                kids += kid.flat()[0] if kid.key == "()" else [kid]
            at: dict[str, list[int]] = {}
            for i, kid in enumerate(kids):
                at.setdefault(kid.key, []).append(i)
            self.places = kids, at
        return self.places


def tree(keys: list[str]) -> Node:
    top = Node("")
    stack = [top]
    for k in keys:
        if k == "/":
            stack.pop()
        else:
            node = Node(k)
            stack[-1].kids.append(node)
            if k != "#":
                stack.append(node)
    return top


def written(node: Node) -> str:
    """A wrapper without roles, as text."""
    plain = lambda x: [x.key, 2 * x.repeated + x.optional, *map(plain, x.kids)]
    return json.dumps(plain(node), separators=(",", ":"))


def read(text: str) -> Node:
    def node(plain: list) -> Node:
        out = Node(plain[0], [node(x) for x in plain[2:]])
        out.repeated, out.optional = bool(plain[1] & 2), bool(plain[1] & 1)
        return out

    return node(json.loads(text))


def _merge(a: Node, b: Node) -> Node:
    """a after it has been aligned with b, which stands in the same place."""
    a.repeated |= b.repeated
    a.optional |= b.optional
    if a.key != "#":
        a.kids = align(a.kids, b.kids)
    return a


def fold(node: Node) -> Node:
    """Runs of like children, then runs of like groups of 2 to 4 children, become repeated ones."""
    kids: list[Node] = []
    for kid in map(fold, node.kids):
        if kids and kids[-1].key == kid.key:
            _merge(kids[-1], kid).repeated = True
        else:
            kids.append(kid)
    for size in (2, 3, 4):
        i = 0
        while i + 2 * size <= len(kids):
            names = [k.key for k in kids[i : i + size]]
            if names != [k.key for k in kids[i + size : i + 2 * size]]:
                i += 1
                continue
            group = kids[i : i + size]
            while [k.key for k in kids[i + size : i + 2 * size]] == names:
                for x, y in zip(group, kids[i + size : i + 2 * size], strict=True):
                    _merge(x, y)
                del kids[i + size : i + 2 * size]
            whole = Node("()", group)
            whole.repeated = True
            kids[i : i + size] = [whole]
            i += 1
    node.kids = kids
    return node


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal keys in both, in ascending order: a longest common subsequence, or a greedy one of very long lists."""
    n, m = len(a), len(b)
    low = 0
    while low < min(n, m) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(n, m) - low and a[n - 1 - high] == b[m - 1 - high]:
        high += 1
    head, tail = [(i, i) for i in range(low)], [(n - k, m - k) for k in range(high, 0, -1)]
    a, b, n, m = a[low : n - high], b[low : m - high], n - low - high, m - low - high
    found: list[tuple[int, int]] = []
    if n * m > PAIRS:
        at: dict[str, list[int]] = {}
        for j, key in enumerate(b):
            at.setdefault(key, []).append(j)
        j = 0
        for i, key in enumerate(a):
            places = at.get(key, [])
            k = bisect_left(places, j)
            if k < len(places):
                found.append((low + i, low + places[k]))
                j = places[k] + 1
        return head + found + tail
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n and j < m:
        if a[i] == b[j]:
            found.append((low + i, low + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return head + found + tail


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """One list of children for both; what only one side has is optional.

    A repeated group matches its like on the other side whether it is repeated there or not.
    """
    out: list[Node] = []

    def alone(nodes: list[Node]) -> None:
        for one in nodes:
            if out and out[-1].key == one.key:  # a mismatch that repeats what stands before it
                _merge(out[-1], one).repeated = True
            else:
                one.optional = True
                out.append(one)

    i = j = 0
    for x, y in [*_matches([k.key for k in a], [k.key for k in b]), (len(a), len(b))]:
        alone(a[i:x])
        alone(b[j:y])
        if x < len(a):
            out.append(_merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def _named(key: str) -> tuple[str, str]:
    tag, _, names = key.removeprefix("<").partition(" ")
    return tag, names


def place(path: list[str]) -> str:
    """What the tags and names above a slot say of it: drop, main or other."""
    main = False
    for depth, key in enumerate(path):
        tag, names = _named(key)
        if tag == "header" and main and any(re.match("<?h[1-6]", k) for k in path[depth + 1 :]):
            continue
        if tag in BOILERPLATE_TAGS or names and _NAMED.search(names):
            return "drop"
        main = main or bool(_MAIN.match(tag)) or "main" in names.split()
    return "main" if main else "other"


def joined(wrappers: Iterable[Node]) -> Node:
    """One wrapper for what all of these fit, aligned one after another."""
    out = None
    for w in wrappers:
        out = _merge(out, w) if out else w
    return out or Node("")


def numbered(wrapper: Node) -> Node:
    """The wrapper with a number for each slot, and what tags and names say of it."""
    n = 0

    def walk(node: Node, path: list[str], single: bool) -> None:
        nonlocal n
        for kid in node.kids:
            here = single and not kid.repeated
            if kid.key == "#":
                kid.slot, kid.single, kid.role, n = n, here, place(path), n + 1
            else:
                walk(kid, path if kid.key == "()" else [*path, kid.key], here)

    walk(wrapper, [], True)
    return wrapper


def settle(wrapper: Node, seen: dict[int, tuple[int, int]]) -> Node:
    """The wrapper with the role of each slot; seen: of each slot, the characters in it on all pages, and those in links.

    main: inside the host's article, or a heading of level 1 before it; drop: boilerplate; other: the rest.
    """
    plain: dict[int, int] = {}
    linked: dict[int, int] = {}
    has_article: dict[int, bool] = {}

    def weigh(node: Node) -> None:
        for kid in node.kids:
            weigh(kid)
        own = seen.get(node.slot, (0, 0)) if node.key == "#" else (0, 0)
        plain[id(node)] = own[0] - own[1] + sum(plain[id(k)] for k in node.kids)
        linked[id(node)] = own[1] + sum(linked[id(k)] for k in node.kids)
        has_article[id(node)] = bool(_MAIN.match(_named(node.key)[0])) or any(has_article[id(k)] for k in node.kids)

    def tagged(node: Node) -> int:
        """Running text in elements that are boilerplate by their tags."""
        return plain[id(node)] if _named(node.key)[0] in BOILERPLATE_TAGS else sum(map(tagged, node.kids))

    weigh(wrapper)
    text = plain[id(wrapper)] - tagged(wrapper)

    def boilerplate(node: Node, article: bool) -> bool:
        tag, names = _named(node.key)
        if node.key in ("#", "()", "") or tag in ("html", "body"):
            return False
        if tag in BOILERPLATE_TAGS:
            return not (tag == "header" and article and _headed(node))
        if names and _NAMED.search(names):
            return not has_article[id(node)] and plain[id(node)] < NEARLY_ALL * text
        links = linked[id(node)]
        return not article and tag not in _PROSE and not has_article[id(node)] and links > 0 and links >= LINKED * (links + plain[id(node)])

    # Down to the element over whose children the running text is spread.
    root = wrapper
    while True:
        kids = [k for k in root.flat()[0] if not boilerplate(k, False)]
        whole = sum(plain[id(k)] for k in kids)
        inner = next((k for k in kids if plain[id(k)] >= DOMINANT * whole > 0), None)
        if inner is None or inner.repeated or _named(inner.key)[0] not in CONTAINERS:
            break
        root = inner
    spread = _named(root.key)[0] in ("", "html", "body")  # the texts do not tell an article from what is beside it

    def walk(node: Node, article: bool, inside: bool, dropped: bool) -> None:
        for kid in node.kids:
            tag, names = _named(kid.key)
            gone = dropped or boilerplate(kid, article)
            here = inside or kid is root or spread and (bool(_MAIN.match(tag)) or "main" in names.split()) or tag == "h1" and not spread and bool(linked[id(kid)] <= plain[id(kid)])
            if kid.key == "#":
                kid.role = "drop" if dropped else "main" if here else "other"
            else:
                walk(kid, article or bool(_MAIN.match(tag)), here, gone)

    walk(wrapper, False, root is wrapper and not spread, False)
    return wrapper


#: Elements of running text, in which a link is a part of it.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main".split())


def _headed(node: Node) -> bool:
    """Whether a heading is in it."""
    return any(re.match("h[1-6]$", _named(k.key)[0]) or _headed(k) for k in node.kids)


def infer(pages: list[str]) -> Node:
    """The wrapper of these pages, with the role of each slot."""
    wrapper = numbered(joined(fold(tree(stream(page)[0])) for page in pages))
    seen: dict[int, tuple[int, int]] = {}
    for keys, texts, linked in map(stream, pages):
        for text, links, slot in zip(texts, linked, slots(wrapper, keys), strict=True):
            had = seen.get(slot.slot, (0, 0))
            seen[slot.slot] = had[0] + len(text), had[1] + links
    return settle(wrapper, seen)


def slots(wrapper: Node, keys: list[str]) -> list[Node]:
    """For each block "#" of a page's keys, the slot it falls on; one of no number where the wrapper has none."""
    found: list[Node] = []
    at: list[tuple[Node | None, int]] = [(wrapper, 0)]
    path: list[str] = []
    for k in keys:
        if k == "/":
            path.pop()
            at.pop()
            continue
        node, cursor = at[-1]
        match = None
        if node is not None:
            kids, index = node.flat()
            places = index.get(k)
            if places:
                nth = places[bisect_left(places, cursor) % len(places)]
                match, at[-1] = kids[nth], (node, nth if kids[nth].repeated else nth + 1)
        if k == "#":
            if match is None:
                match = Node("#")
                match.role = place(path)
            found.append(match)
        else:
            path.append(k)
            at.append((match, 0))
    return found


def text_hash(text: str) -> int:
    """64 bits, signed."""
    return (xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) ^ 1 << 63) - (1 << 63)


class Reader:
    """Texts of a page's blocks with their links and slots; structures once seen are remembered, within a bound."""

    LIMIT = 20_000

    def __init__(self) -> None:
        self.known: dict[tuple, list[Node]] = {}

    def __call__(self, name: object, wrapper: Node, page: str) -> list[tuple[str, int, Node]]:
        keys, texts, linked = stream(page)
        memo = (name, *keys)
        found = self.known.get(memo)
        if found is None:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            found = self.known[memo] = slots(wrapper, keys)
        return list(zip(texts, linked, found, strict=True))


def content(blocks: list[tuple[str, int, Node]], template: dict[int, int]) -> str:
    """Text of the article, or else what is no boilerplate; the template's own texts (slot -> hash) are not content."""
    own = lambda text, slot: slot.slot in template and template[slot.slot] == text_hash(text)
    role = "main" if any(slot.role == "main" for _, _, slot in blocks) else "other"
    return "\n".join(text for text, _, slot in blocks if slot.role == role and not own(text, slot))


def _slim(pages: DataFrame) -> DataFrame:
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    return slim.withColumn("host", host_and_path(F.col("url"))[0])


def _decoded(page: bytes | None) -> str:
    return (page or b"").decode("utf-8", "replace")


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, shape: the folded structures of the pages, most of them once."""
    known: set[int] = set()
    sent: set[int] = set()
    for batch in batches:
        rows = []
        for host, page in zip(batch.column("host").to_pylist(), bytes_of(batch.column("html")), strict=True):
            keys = stream(_decoded(page))[0]
            memo = hash((host, *keys))
            if memo in known:
                continue
            if len(known) >= Reader.LIMIT:
                known.clear()
                sent.clear()
            known.add(memo)
            row = (host, written(fold(tree(keys))))
            if hash(row) not in sent:
                sent.add(hash(row))
                rows.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["host", "shape"])


def fit(pages: DataFrame) -> DataFrame:
    """host, wrapper (pickled) for every host."""
    shapes = arrow_map(_slim(pages).select("host", "html"), _shapes, "host string, shape string").distinct()

    def part(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [group["host"].iloc[0]], "salt": [group["salt"].iloc[0]], "shape": [written(joined(map(read, sorted(group["shape"]))))]})

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        wrapper = numbered(joined(map(read, group.sort_values("salt")["shape"])))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [pickle.dumps(wrapper)]})

    salted = shapes.withColumn("salt", F.pmod(F.xxhash64("shape"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("host", "salt").applyInPandas(part, "host string, salt int, shape string")
    return parts.groupBy("host").applyInPandas(whole, "host string, wrapper binary")


def _over(slim: DataFrame, models: DataFrame, run: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema: str) -> DataFrame:
    """run on every batch of pages, with each page's (blob, wrapper, template's texts: slot -> hash)."""
    size = models.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 100)).first()[0] or 0
    shipped = slim.sparkSession.sparkContext.broadcast({r.host: bytes(r.wrapper) for r in models.collect()}) if size <= BROADCAST else None
    if shipped is None:
        slim = slim.join(models, "host", "left")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[bytes | None, tuple] = {}
        reader = Reader()
        for batch in batches:
            blobs = [shipped.value.get(h) for h in batch.column("host").to_pylist()] if shipped else list(bytes_of(batch.column("wrapper")))
            pages = []
            for blob, page in zip(blobs, bytes_of(batch.column("html")), strict=True):
                if blob not in loaded:
                    if len(loaded) >= 5000:
                        loaded.clear()
                    found = pickle.loads(blob) if blob else Node("")
                    loaded[blob] = found if isinstance(found, tuple) else (found, {})
                wrapper, template = loaded[blob]
                pages.append((reader(hash(blob), wrapper, _decoded(page)), template))
            yield run(batch, pages)

    return arrow_map(slim, over, schema)


def _evidence(batch: pa.RecordBatch, pages: list) -> pa.RecordBatch:
    """host, body, and of each slot its number, characters, those in links, and its text's hash if it is single (else 0); slot -1 is the page itself."""
    out = []
    for host, (blocks, _) in zip(batch.column("host").to_pylist(), pages, strict=True):
        told = [(slot.slot, text_hash(text)) for text, _, slot in blocks if slot.role != "drop"]
        if blocks:
            sums: dict[int, list[int]] = {-1: [0, 0, 0]}
            for text, links, slot in blocks:
                if slot.slot >= 0:
                    of = sums.setdefault(slot.slot, [0, 0, 0])
                    of[0], of[1] = of[0] + len(text), of[1] + links
                    of[2] = text_hash(text) if slot.single and slot.role != "drop" else 0
            body = text_hash(repr(told) if told else repr([text for text, _, _ in blocks]))
            out.append((host, body, list(sums), *([x[k] for x in sums.values()] for k in range(3))))
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["host", "body", "slots", "chars", "links", "hashes"])


def statistics(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host, seen (slot, chars, links), template (slot, h): sums over a host's different pages, and the texts that SHARE of them have in a slot."""
    bodies = _over(_slim(pages).select("host", "html"), wrappers, _evidence, "host string, body long, slots array<int>, chars array<long>, links array<long>, hashes array<long>")
    bodies = bodies.groupBy("host", "body").agg(F.first(F.arrays_zip("slots", "chars", "links", "hashes")).alias("xs"))
    texts = bodies.select("host", F.explode("xs").alias("x")).groupBy("host", F.col("x.slots").alias("slot"), F.col("x.hashes").alias("h"))
    texts = texts.agg(F.count(F.lit(1)).alias("n"), F.sum("x.chars").alias("chars"), F.sum("x.links").alias("links"))
    most = texts.groupBy("host", "slot").agg(F.max(F.struct("n", "h")).alias("most"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    most = most.groupBy("host").agg(F.collect_list(F.struct("slot", "chars", "links", "most")).alias("xs"), F.max(F.when(F.col("slot") < 0, F.col("most.n"))).alias("pages"))
    own = F.filter("xs", lambda x: (x.slot >= 0) & (x.most.h != 0) & (x.most.n >= LEAST) & (x.most.n >= SHARE * F.col("pages")))
    return most.select("host", F.transform(F.filter("xs", lambda x: x.slot >= 0), lambda x: F.struct(x.slot, x.chars, x.links)).alias("seen"), F.transform(own, lambda x: F.struct(x.slot.alias("slot"), x.most.h.alias("h"))).alias("template"))


def models(pages: DataFrame) -> DataFrame:
    """host, wrapper: a pickled wrapper with the roles of its slots and its template's texts."""
    scratch = Scratch(pages.sparkSession, "wrappers")
    wrappers = scratch.keep(fit(pages), "hosts")

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for blob, seen, template in zip(bytes_of(batch.column("wrapper")), batch.column("seen").to_pylist(), batch.column("template").to_pylist(), strict=True):
                wrapper = settle(pickle.loads(blob), {x["slot"]: (x["chars"], x["links"]) for x in seen or ()})
                found.append(pickle.dumps((wrapper, {x["slot"]: x["h"] for x in template or ()})))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.binary())], ["host", "wrapper"])

    return scratch.keep(arrow_map(wrappers.join(statistics(pages, wrappers), "host", "left"), both, "host string, wrapper binary"), "models")


def _extracted(batch: pa.RecordBatch, pages: list) -> pa.RecordBatch:
    texts = [content(*page) for page in pages]
    columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """What SCHEMA lists, for every page."""
    return _over(_slim(pages), models(pages), _extracted, SCHEMA)
