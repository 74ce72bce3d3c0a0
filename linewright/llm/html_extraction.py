"""Main text of web pages by template deduction from equivalence classes of tokens.

Tokens of a page are its tags and words, each with the path of elements around
it. Tokens that occur equally often on every page of a host share an occurrence
vector; tokens of one vector form an equivalence class. A class is valid if its
tokens come in the same order wherever it occurs and no other class is left open
across it. The valid classes of a host, one nested in a gap of another, are the
host's template, and what lies in the gaps is a slot. Main text is taken from the
slots: the template's own words go, the slots inside menus, notices, adverts,
forms, comments and link lists go, and where a page marks no article the slots of
the deepest template element that holds most of the host's text are taken.

Occurrence vectors are compared by sums of hashes of (page, count), so they add up
over tasks; a host of any size is spread over all of them. Templates are as large
as pages. They are broadcast up to a checked size; beyond, pages and templates are
dealt by (host, salt) and a template streams ahead of its pages.
"""

from __future__ import annotations

import html as entities
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.functions.ordered import small_side
from linewright.llm.common import free_name, stored
from linewright.llm.html_pages import CLOSE, HEADINGS, INLINE, OPEN, TEXT, Node, events, token

#: Runs of text up to so many words give a token for each word, longer ones a single token.
WORD_RUN = 24
#: A tag belongs to the template from this share of a host's pages on; words from a larger one, on hosts of some pages.
TAG_SHARE, WORD_SHARE, WORD_PAGES = 0.2, 0.8, 5
#: A template element that holds this share of the host's text is taken where pages mark no article.
REGION_SHARE = 0.7
#: A list whose words are links to this share, over all pages of the host, is a menu.
LINK_SHARE = 0.8
#: Serialised templates up to so many bytes are broadcast.
BROADCAST_TEMPLATES = 1 << 25
#: Hosts up to so many are broadcast with their numbers of pages.
BROADCAST_HOSTS = 200_000
#: Pages of a host that follow one copy of its template where templates are not broadcast.
PAGES_PER_SALT = 2000
#: Tokens that a task holds before it passes its sums on.
HELD_TOKENS = 300_000

LISTS = frozenset("ul ol dl table".split())
#: Elements that may be the text region of a page.
BOXES = frozenset("body div section article main center td".split())
#: What a token is, in the low bits of its kind; from bit DEPTH on, the depth of an element.
ELEMENT, SILENT, WORD, BOX, DEPTH = 1, 2, 4, 8, 8

TOKENS = "host string, token long, high long, low long, pages long, total long, at struct<page:long,first:long>, words long, links long, kind long"


def host_of(url: str) -> Column:
    """Scheme, user, port, path and case aside; null urls make one host."""
    rest = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|^//", "")
    return F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@|:[0-9]*$", ""))


#: Seeds of the text outside all elements.
_BARE = 1, 2


def run_tokens(node: Node | None, raw: str) -> list[int]:
    words = raw.split()
    by_word, whole = node.role.words if node else _BARE
    return [token(w, by_word) for w in words] if len(words) <= WORD_RUN else [token(" ".join(words), whole)]


class Walk:
    """Steps through a page's events with what surrounds the current one."""

    def __init__(self, page: str) -> None:
        self.events = events(page)
        self.silent = self.links = self.depth = 0

    def __iter__(self) -> Iterator[tuple]:
        for event in self.events:
            kind, node = event[0], event[1]
            if kind == OPEN:
                self.depth += 1
                self.silent += node.aside or node.named
                self.links += node.name == "a"
            yield event
            if kind == CLOSE:
                self.depth -= 1
                self.silent -= node.aside or node.named
                self.links -= node.name == "a"


def page_tokens(page: str) -> dict[int, list[int]]:
    """token -> [count, place of the first, words inside, words inside links, kind]."""
    out: dict[int, list[int]] = {}
    walk, words, linked, place = Walk(page), 0, 0, 0
    begun: list[tuple[list[int], int, int]] = []
    for event in walk:
        node = event[1]
        place += 1
        if event[0] == TEXT:
            size = len(event[2].split())
            if not walk.silent:
                words += size
                linked += size if walk.links else 0
            for word in run_tokens(node, event[2]) if size else ():
                out.setdefault(word, [0, place, 0, 0, WORD])[0] += 1
                place += 1
            continue
        if event[0] == OPEN:
            kind = ELEMENT | (SILENT if walk.silent else 0) | (BOX if node.name in BOXES else 0) | walk.depth << DEPTH
            entry = out.setdefault(node.opened, [0, place, 0, 0, kind])
            begun.append((entry, words, linked))
        else:
            entry, words_then, linked_then = begun.pop()
            entry[2] += words - words_then
            entry[3] += linked - linked_then
            entry = out.setdefault(node.role.closed, [0, place, 0, 0, 0])
        if event[0] == OPEN or entry[4] == 0:
            entry[0] += 1
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a task's pages for every (host, token); token 0 counts the pages themselves."""
    held: dict[tuple[str, int], list] = {}

    def rows() -> pa.RecordBatch:
        table = {"host": [h for h, _ in held], "token": [t for _, t in held]}
        for i, name in enumerate(("high", "low", "pages", "total")):
            table[name] = [v[i] for v in held.values()]
        arrays = {k: pa.array(v, pa.string() if k == "host" else pa.int64()) for k, v in table.items()}
        places = [pa.array([v[4][i] for v in held.values()], pa.int64()) for i in (0, 1)]
        arrays["at"] = pa.StructArray.from_arrays(places, names=["page", "first"])
        for i, name in enumerate(("words", "links", "kind"), 5):
            arrays[name] = pa.array([v[i] for v in held.values()], pa.int64())
        return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            key = token(page, 0)
            marks: dict[int, int] = {}
            found = page_tokens(page)
            found[0] = [1, 0, 0, 0, 0]
            for name, (count, first, words, links, kind) in found.items():
                mark = marks.get(count)
                if mark is None:
                    mark = marks[count] = xxhash.xxh3_64_intdigest(str(count), key & 0xFFFFFFFFFFFFFFFF)
                sums = held.get((host, name))
                if sums is None:
                    held[host, name] = [mark >> 32, mark & 0xFFFFFFFF, 1, count, (key, first), words, links, kind]
                else:
                    sums[0] += mark >> 32
                    sums[1] += mark & 0xFFFFFFFF
                    sums[2] += 1
                    sums[3] += count
                    sums[4] = min(sums[4], (key, first))
                    sums[5] += words
                    sums[6] += links
            if len(held) > HELD_TOKENS:
                yield rows()
                held = {}
    if held:
        yield rows()


class Template:
    """The classes of a host's tokens, their order, and its text region."""

    def __init__(self, rows: list[tuple], pages: int) -> None:
        """``rows``: token, high, low, pages, total, (page, first), words, links, kind of the tokens on enough pages."""
        self.pages = pages
        classes: dict[tuple, list[tuple]] = {}
        for name, high, low, support, total, at, _, _, kind in rows:
            classes.setdefault((high, low, support, total), []).append((at, name, bool(kind & WORD)))
        self.place: dict[int, tuple[int, int]] = {}
        #: Class by class, the tokens in order and which of them are words.
        self.order: list[list[int]] = []
        self.words: set[int] = set()
        for number, key in enumerate(sorted(classes)):
            members = sorted(classes[key])
            self.order.append([name for _, name, _ in members])
            self.words.update(name for _, name, word in members if word)
            self.place.update({name: (number, i) for i, (_, name, _) in enumerate(members)})
        self.menus = {r[0] for r in rows if r[8] & ELEMENT and r[6] and r[7] >= LINK_SHARE * r[6]}
        text = max((r[6] for r in rows if r[8] & ELEMENT), default=0)
        boxes = [r for r in rows if r[8] & BOX and not r[8] & SILENT and r[4] == r[3] and r[6] >= max(1, REGION_SHARE * text) and 2 * r[7] <= r[6]]
        self.boxes = [(r[8] >> DEPTH, r[6], r[0]) for r in boxes]
        self.bad: frozenset[int] = frozenset()
        self.stray: frozenset[int] = frozenset()

    def faults(self, page: str) -> tuple[set[int], set[int]]:
        """Classes whose tags come in another order on this page or that stay open across another's token, and stray words.

        A word that stands in another place of its class than elsewhere is there by chance: it leaves, the class stays.
        """
        bad: set[int] = set()
        stray: set[int] = set()
        open_classes: list[list[int]] = []

        def skipped(number: int, start: int, end: int) -> bool:
            """Whether the class can do without the tokens in between: all of them words, which become stray."""
            between = self.order[number][start:end]
            if not self.words.issuperset(between):
                bad.add(number)
                return False
            stray.update(between)
            return True

        def leave(depth: int) -> None:
            """End the classes above ``depth``, which have not come to their last token."""
            while len(open_classes) > depth:
                number, at = open_classes.pop()
                skipped(number, at, len(self.order[number]))

        for name in sequence(page):
            found = self.place.get(name)
            if found is None or found[0] in bad or name in stray:
                continue
            number, at = found
            depth = next((i for i in range(len(open_classes) - 1, -1, -1) if open_classes[i][0] == number), None)
            if depth is not None and at >= open_classes[depth][1]:
                leave(depth + 1)
                if not skipped(number, open_classes[depth][1], at):
                    open_classes.pop()
                    continue
                open_classes[depth][1] = at + 1
            elif depth is not None and name in self.words:
                stray.add(name)
                continue
            else:
                if depth is not None:
                    leave(depth)
                if number in bad or not skipped(number, 0, at):
                    continue
                open_classes.append([number, at + 1])
            if open_classes[-1][1] == len(self.order[number]):
                open_classes.pop()
        leave(0)
        return bad, stray

    def holds(self, name: int) -> bool:
        found = self.place.get(name)
        return found is not None and found[0] not in self.bad and name not in self.stray

    def region(self) -> int | None:
        """The open tag of the deepest sound template element that holds most of the host's text."""
        sound = [b for b in self.boxes if self.holds(b[2])]
        return max(sound)[2] if sound else None

    def fixed_word(self, name: int) -> bool:
        return name in self.words and self.holds(name)


def sequence(page: str) -> Iterator[int]:
    for event in events(page):
        if event[0] == TEXT:
            yield from run_tokens(event[1], event[2])
        else:
            yield event[1].opened if event[0] == OPEN else event[1].role.closed


class Blocks:
    """Gathers the blocks of one reading of a page."""

    def __init__(self) -> None:
        self.done: list[tuple[str, bool]] = []
        self.parts: list[str] = []
        self.own = False

    def add(self, text: str, own: bool) -> None:
        self.parts.append(text)
        self.own |= own

    def end(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.done.append((text, self.own))
        self.parts, self.own = [], False


def read_slots(page: str, template: Template, strict: bool) -> list[str]:
    """Blocks of the page's slots that are main text; without ``strict``, class names silence nothing."""
    walk = Walk(page).events
    marked = _marked(walk, strict)
    box = None if marked else template.region()
    if box is not None and not any(e[0] == OPEN and e[1].opened == box for e in walk):
        box = None
    blocks, silent, inside, heads, articles, mains, headings = Blocks(), 0, 0, 0, 0, 0, 0
    for event in walk:
        kind, node = event[0], event[1]
        if kind == TEXT:
            if silent or heads and not headings or not (inside or not marked and box is None):
                continue
            names = run_tokens(node, event[2])
            blocks.add(entities.unescape(event[2]), not all(map(template.fixed_word, names)))
            continue
        name = node.name
        if name not in INLINE and name != "br":
            blocks.end()
        elif name == "br" and kind == OPEN:
            blocks.add(" ", False)
        step = 1 if kind == OPEN else -1
        if kind == CLOSE:
            articles -= name == "article"
            mains -= name == "main"
        quiet = node.aside or strict and node.named or name in LISTS and node.opened in template.menus
        # The head of an article keeps its headings; an article inside another is a comment on it.
        if name == "header":
            if articles or mains:
                heads += step
            else:
                quiet = True
        elif name == "article" and articles > 0:
            quiet = True
        if kind == OPEN:
            articles += name == "article"
            mains += name == "main"
        headings += step if name in HEADINGS else 0
        silent += step if quiet else 0
        if marked and name == marked or box is not None and node.opened == box:
            inside += step
    blocks.end()
    kept = [text for text, own in blocks.done if own]
    # A page that is nothing but template would lose its article with its copies: it keeps it.
    return kept or [text for text, _ in blocks.done]


def _marked(walk: list[tuple], strict: bool) -> str | None:
    """``article`` or else ``main`` if the page has one that holds text outside everything silenced."""
    within = {"article": 0, "main": 0}
    silent, main = 0, False
    for event in walk:
        if event[0] == TEXT:
            if not silent and (within["article"] or within["main"]) and event[2].strip():
                if within["article"]:
                    return "article"
                main = True
            continue
        node, step = event[1], 1 if event[0] == OPEN else -1
        silent += step if node.aside or strict and node.named else 0
        if node.name in within:
            within[node.name] += step
    return "main" if main else None


def main_text(page: str, template: Template) -> str:
    return "\n\n".join(read_slots(page, template, True) or read_slots(page, template, False))


def _with_templates(pages: DataFrame, templates: DataFrame, work: Callable, schema: str | T.StructType) -> DataFrame:
    """``work(template, rows)`` for the pages (host, html, ...) of every host: an iterator of record batches.

    ``templates``: host, pages, template (pickled). Broadcast where all of them are
    small; else a host's pages are dealt over salts, each behind a copy of the template.
    """
    spark = pages.sparkSession
    known = templates.agg(F.sum(F.octet_length("template") + F.octet_length("host") + 64).alias("bytes")).first()["bytes"] or 0
    if known <= BROADCAST_TEMPLATES:
        shared = spark.sparkContext.broadcast({r["host"]: bytes(r["template"]) for r in templates.collect()})

        def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[str, Template] = {}

            def of(host: str) -> Template:
                if host not in made:
                    made[host] = pickle.loads(shared.value[host])
                return made[host]

            yield from work((of, batch) for batch in batches)

        return pages.mapInArrow(apart, schema)

    salts = templates.select("host", F.ceil(F.col("pages") / PAGES_PER_SALT).cast("int").alias("_salts"))
    salted = pages.join(salts, "host").withColumn("_salt", F.pmod(F.xxhash64("html"), F.col("_salts")).cast("int")).drop("_salts")
    copies = templates.join(salts, "host").select("host", "template", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    both = salted.withColumn("template", F.lit(None).cast("binary")).unionByName(copies, allowMissingColumns=True)
    dealt = both.repartition("host", "_salt").sortWithinPartitions("host", "_salt", F.col("template").isNull())

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Template] = {}

        def parts() -> Iterator[tuple]:
            for batch in batches:
                given = batch.column(batch.schema.get_field_index("template"))
                hosts = batch.column(0)
                cuts = [i for i in range(batch.num_rows) if given[i].is_valid]
                for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                    if start in cuts:
                        held.clear()
                        held[hosts[start].as_py()] = pickle.loads(given[start].as_py())
                        start += 1
                    if end > start:
                        yield dict(held).__getitem__, batch.slice(start, end - start)

        yield from work(parts())

    return dealt.select("host", "html", *[c for c in pages.columns if c not in ("host", "html")], "template").mapInArrow(streamed, schema)


def host_templates(pages: DataFrame) -> DataFrame:
    """host, pages, template (pickled ``Template``) of ``pages`` (host, html)."""
    sums = stored(pages.select("host", "html").mapInArrow(_tokens, TOKENS), "page-tokens")
    whole = sums.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("high", "low", "pages", "total")], F.min("at").alias("at"), F.sum("words").alias("words"), F.sum("links").alias("links"), F.max("kind").alias("kind"))
    hosts = sums.where("token = 0").groupBy("host").agg(F.sum("pages").alias("all_pages"))
    enough = F.when(F.col("kind").bitwiseAND(WORD) == 0, F.col("pages") >= TAG_SHARE * F.col("all_pages")).otherwise((F.col("all_pages") >= WORD_PAGES) & (F.col("pages") >= WORD_SHARE * F.col("all_pages")))
    # A host's tokens may be a third of all, so its one row is broadcast while the hosts are few; beyond, hot ones are split by adaptive execution.
    rows = whole.where("token <> 0").join(small_side(stored(hosts, "hosts"), most=BROADCAST_HOSTS), "host").where(enough)
    fields = ("token", "high", "low", "pages", "total", "at", "words", "links", "kind")
    gathered = rows.groupBy("host").agg(F.collect_list(F.struct(*fields)).alias("rows"))
    gathered = hosts.join(gathered, "host", "left").select("host", F.col("all_pages").alias("pages"), F.coalesce("rows", F.array().cast(gathered.schema["rows"].dataType)).alias("rows"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for count, rows in zip(batch.column(1).to_pylist(), batch.column(2)):
                members = [(*[r[f] for f in fields[:5]], (r["at"]["page"], r["at"]["first"]), *[r[f] for f in fields[6:]]) for r in rows.as_py()]
                made.append(pickle.dumps(Template(members, count)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["host", "pages", "template"])

    drafts = stored(gathered.mapInArrow(build, "host string, pages long, template binary"), "page-classes")

    def check(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[str, bool, int]] = set()
        for of, batch in parts:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, faulty in zip((False, True), of(host).faults(page)):
                    found.update((host, word, f) for f in faulty)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["host", "word", "number"])

    faulty = _with_templates(pages.select("host", "html"), drafts, check, "host string, word boolean, number long")
    sets = [F.collect_set(F.when(F.col("word") == w, F.col("number"))).alias(n) for w, n in ((False, "bad"), (True, "stray"))]
    faulty = faulty.groupBy("host").agg(*sets)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for template, bad, stray in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))):
                one = pickle.loads(template)
                one.bad, one.stray = frozenset(bad or ()), frozenset(stray or ())
                made.append(pickle.dumps(one))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["host", "pages", "template"])

    return stored(drafts.join(faulty, "host", "left").select("host", "pages", "template", "bad", "stray").mapInArrow(settle, "host string, pages long, template binary"), "page-templates")


def main_texts(pages: DataFrame, *, html: str = "html", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default but ``html``), text and n_chars (its code points) of every page.

    Text: blocks in page order with an empty line between them, white space inside a
    block as single blanks, character references decoded.

    Null or empty html gives an empty text; pages without a url are taken for one host's; repeated
    rows stay rows; a host of one page is its own template; a kept column named text
    or n_chars gives way to the result. An empty table gives no rows.
    """
    names = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ("text", "n_chars") and not (keep is None and c == html)]
    aside = free_name("row", ["host", "html", "template", "_salt"])
    rows = pages.select(host_of(url).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"), F.struct(*[F.col(c) for c in names]).alias(aside) if names else F.lit(0).alias(aside))
    templates = host_templates(rows)
    schema = T.StructType([rows.schema[aside], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for of, batch in parts:
            texts = [main_text(page, of(host)) for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[aside, "text", "n_chars"])

    found = _with_templates(rows, templates, extract, schema)
    return found.select(*[F.col(f"{aside}.`{c}`").alias(c) for c in names], "text", "n_chars")
