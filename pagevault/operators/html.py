"""HTML pages to element tokens, main content, Markdown.

Each page is parsed once, by `parse_pages`, into an array of tokens in document order (element start, text, element
end). Everything after is column expressions over that array inside the page's own row, so the whole job is one
scan without a shuffle, and a page that breaks the parser is one row with an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagevault.functions import absolute_url, base_url, fixed, trim_code_head
from pagevault.functions.core import constant_array, constant_map, let, sql_string
from pagevault.functions.text import strip
from pagevault.operators.rows import explode_once, portions
from pagevault.operators.tabs import page_type

TOKEN = (
    "struct<pos:int,end_pos:int,kind:string,tag:string,path:string,depth:int,nth:int,"
    "attrs:map<string,string>,text:string,flags:int>"
)
TOKENS = f"array<{TOKEN}>"

# Bits of `flags`: what a token is or lies in.
IN_DROPPED, IN_UNCONVERTED, IN_HANDLER, IN_PRE, IN_CODE = 1, 2, 4, 8, 16
_TAG_FLAGS = {
    **{t: IN_DROPPED for t in fixed.DROPPED_TAGS},
    **{t: IN_UNCONVERTED for t in fixed.UNCONVERTED_TAGS},
    "pre": IN_PRE | IN_CODE,
    **{t: IN_CODE for t in ("code", "kbd", "samp")},
}

# Fixed values of the HTML standard: elements without content, and starts that end an open paragraph.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
ENDS_SIBLING = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
SCOPES = frozenset("ul ol table dl select html body".split())


class _TokenReader(HTMLParser):
    """Turns one page into token tuples; closes what the page leaves open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tokens: list[list] = []
        self.stack: list[int] = []
        self.children: list[dict[str, int]] = [{}]

    def _path(self) -> str:
        return self.tokens[self.stack[-1]][4] if self.stack else ""

    def _inherited(self) -> int:
        return self.tokens[self.stack[-1]][9] if self.stack else 0

    def _pop(self) -> None:
        start = self.tokens[self.stack.pop()]
        self.children.pop()
        start[1] = len(self.tokens)
        self.tokens.append(
            [start[1], start[1], "end", start[3], start[4], start[5], start[6], start[7], None, start[9]]
        )

    def _close(self, tags: set[str] | frozenset[str], scopes: frozenset[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.tokens[self.stack[i]][3]
            if tag in tags:
                while len(self.stack) > i:
                    self._pop()
                return
            if tag in scopes:
                return

    def handle_starttag(self, tag, attrs) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, SCOPES | {"div", "section", "article", "li", "td", "th", "button"})
        if tag in ENDS_SIBLING:
            self._close(ENDS_SIBLING[tag], SCOPES)
        values = {k: (v or "") for k, v in reversed(attrs)}
        seen = self.children[-1]
        seen[tag] = seen.get(tag, 0) + 1
        flags = self._inherited() | _TAG_FLAGS.get(tag, 0)
        if any(k.startswith("on") for k in values):
            flags |= IN_HANDLER
        path = f"{self._path()}/{tag}"
        pos = len(self.tokens)
        self.tokens.append([pos, pos, "start", tag, path, path.count("/"), seen[tag], values, None, flags])
        if tag not in VOID_TAGS:
            self.stack.append(pos)
            self.children.append({})

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag) -> None:
        if tag not in VOID_TAGS:
            self._close({tag}, frozenset())

    def handle_data(self, data) -> None:
        pos, path = len(self.tokens), self._path()
        self.tokens.append([pos, pos, "text", "#text", path, path.count("/") + 1, 0, None, data, self._inherited()])


def _read(html: str | None) -> tuple[list[list], str | None]:
    if html is None:
        return [], None
    reader = _TokenReader()
    error = None
    try:
        reader.feed(html)
        reader.close()
    except Exception as e:  # one bad page must not fail the job: it becomes a row with an error
        error = f"{type(e).__name__}: {e}"
    while reader.stack:
        reader._pop()
    return reader.tokens, error


def _offsets(lengths: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32))


def _token_column(pages: list[list[list]]) -> pa.Array:
    """Tokens of a batch of pages as one Arrow list column, built field by field."""
    flat = [t for tokens in pages for t in tokens]
    cols = list(zip(*flat)) if flat else [()] * 10
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), None, pa.string(), pa.int32()]
    attrs = [a or {} for a in cols[7]]
    fields = []
    for values, kind in zip(cols, kinds):
        if kind is not None:
            fields.append(pa.array(values, kind))
        else:
            keys = pa.array([k for a in attrs for k in a], pa.string())
            items = pa.array([v for a in attrs for v in a.values()], pa.string())
            fields.append(pa.MapArray.from_arrays(_offsets([len(a) for a in attrs]), keys, items))
    names = ["pos", "end_pos", "kind", "tag", "path", "depth", "nth", "attrs", "text", "flags"]
    return pa.ListArray.from_arrays(_offsets([len(p) for p in pages]), pa.StructArray.from_arrays(fields, names))


PARSE_BYTES = 1 << 20  # of HTML whose tokens a worker holds at a time, at least one page
SUM_TOKENS = 1 << 17  # tokens whose sums a worker makes at a time, at least one page's


def _token_batches(batches: Iterator[pa.RecordBatch], names: list[str], html: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        sizes = pc.fill_null(pc.binary_length(whole.column(whole.schema.get_field_index(html))), 0)
        for begin, end in portions(sizes.to_numpy(zero_copy_only=False), PARSE_BYTES):
            batch = whole.slice(begin, end - begin)
            read = [_read(h.as_py()) for h in batch.column(batch.schema.get_field_index(html))]
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            tokens = _token_column([r[0] for r in read])
            errors = pa.array([r[1] for r in read], pa.string())
            yield pa.RecordBatch.from_arrays([*kept, tokens, errors], names=[*names, "tokens", "error"])


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns but the HTML, plus `tokens` and `error`. The only Python in the HTML jobs.

    Tokens take many times the room of their HTML, so they are handed on in portions of PARSE_BYTES of HTML, however large a batch is.
    """
    others = [f for f in pages.schema.fields if f.name != html]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [f"tokens {TOKENS}", "error string"])
    names = [f.name for f in others]

    return pages.select(*names, html).mapInArrow(lambda batches: _token_batches(batches, names, html), ddl)


def html_elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The element table: one row per element start and per text."""
    parsed = parse_pages(pages.select(key, html), html)
    return element_rows(parsed, key)


def element_rows(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    rows = explode_once(parsed, F.filter("tokens", lambda t: t["kind"] != "end"), key, item="t")
    return rows.select(key, "t.*")


def _has(t: Column, bits: int) -> Column:
    return t["flags"].bitwiseAND(F.lit(bits)) != 0


def strip_nodes(parsed: DataFrame, col: str = "tokens", banner: str | None = fixed.BANNER_PATTERN) -> DataFrame:
    """Drop scripts, styles and their like, elements with inline handlers (each with its subtree), and texts that match `banner`.

    Comments are no tokens: the parse leaves them out.
    """

    def kept_token(t):
        kept = ~_has(t, IN_DROPPED | IN_HANDLER)
        return kept & ~F.coalesce(t["text"].rlike(banner), F.lit(False)) if banner else kept

    kept = F.filter(col, kept_token)
    return parsed.withColumn(col, kept)


def absolutize_links(parsed: DataFrame, base: Column, col: str = "tokens") -> DataFrame:
    """href and src attributes made absolute against `scheme://host`."""

    def fix(k: Column, v: Column) -> Column:
        keep_href = v.rlike("^(https?://|mailto:|tel:|#|javascript:)")
        keep_src = v.rlike("^(https?://|data:|//|javascript:)")
        joined = absolute_url(F.regexp_replace(v, "^//", "///"), base)
        scheme = F.concat(F.regexp_extract(base, "^(https?:)", 1), v)
        href = F.when(keep_href, v).when(v.startswith("//"), scheme).otherwise(joined)
        src = F.when(keep_src, v).otherwise(joined)
        return F.when(base.isNull(), v).when(k == "href", href).when(k == "src", src).otherwise(v)

    def fixed_token(t: Column) -> Column:
        links = (t["kind"] != "text") & (t["attrs"].isNotNull())
        has = links & (F.map_contains_key(t["attrs"], "href") | F.map_contains_key(t["attrs"], "src"))
        return F.when(has, t.withField("attrs", F.transform_values(t["attrs"], fix))).otherwise(t)

    return parsed.withColumn(col, F.transform(col, fixed_token))


def _attr(t: Column, name: str) -> Column:
    return F.try_element_at(t["attrs"], F.lit(name))


def _selector_array(selectors: Sequence[str]) -> Column:
    """A constant ARRAY<STRUCT(rank, selector, way, name)> of tag, `.class` and `#id` selectors."""
    ways = {".": "class", "#": "id"}
    rows = []
    for rank, s in enumerate(selectors):
        way = ways.get(s[0], "tag")
        name = s if way == "tag" else s[1:]
        rows.append(
            f"named_struct('rank', {rank}, 'selector', {sql_string(s)}, 'way', '{way}', 'name', {sql_string(name)})"
        )
    return F.expr("array(" + ", ".join(rows) + ")")


def _selects(t: Column, s: Column) -> Column:
    """The token starts an element that the selector picks."""
    classes = F.split(F.coalesce(_attr(t, "class"), F.lit("")), r"\s+")
    return (t["kind"] == "start") & F.when(s["way"] == "tag", t["tag"] == s["name"]).when(
        F.size(t["attrs"]) == 0, F.lit(False)
    ).when(s["way"] == "id", F.coalesce(_attr(t, "id") == s["name"], F.lit(False))).otherwise(
        F.array_contains(classes, s["name"])
    )


def _first(tokens: Column, test) -> Column:
    return F.try_element_at(F.filter(tokens, test), F.lit(1))


def _first_tag(tokens: Column, tag: str) -> Column:
    return _first(tokens, lambda t: (t["kind"] == "start") & (t["tag"] == tag))


def _range(tokens: Column, node: Column) -> Column:
    """The node's own token, its subtree and its end token."""
    return F.filter(tokens, lambda t: t["pos"].between(node["pos"], node["end_pos"]))


_SUMS = "struct<n_elements:int,n_p:int,n_h:int,text_len:int,from:int,size:int,paras:int,para_len:int>"
_START, _P, _H = 1, 2, 4


def _sums(tokens: pa.Array) -> pa.Array:
    """For each token (pos, end_pos, code, length): counts of what lies inside its element, and where its subtree is in the array.

    Running sums by position, and two look-ups in them per token: the work is n log n for n tokens, over the pages of SUM_TOKENS at once.
    """
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    parts = [_sums_at_once(tokens.slice(begin, end - begin)) for begin, end in portions(sizes, SUM_TOKENS)]
    return pa.concat_arrays(parts) if parts else _sums_at_once(tokens)


def _sums_at_once(tokens: pa.Array) -> pa.Array:
    flat = tokens.flatten()
    pos, end, code, length = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
    offsets = tokens.offsets.to_numpy()
    sizes = np.diff(offsets)
    page = np.repeat(np.arange(len(sizes)), sizes) << 32
    place = pos + page  # rises from token to token
    upto = lambda values: np.concatenate(([0], np.cumsum(values)))
    at = np.arange(len(place))
    last = np.searchsorted(place, end + page, side="right")  # behind the end token
    inner = np.maximum(np.searchsorted(place, end + page, side="left"), at + 1)

    def within(values: np.ndarray, until: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = upto(values)
        return total[until] - total[first]

    starts, paras = (code & _START) > 0, (code & _P) > 0
    text = within(length, inner, at + 1)
    first = np.cumsum(sizes) - sizes
    columns = [
        within(starts, inner, at + 1), within(paras, inner, at + 1), within((code & _H) > 0, inner, at + 1), text,
        at - np.repeat(first, sizes) + 1, last - at, within(paras, last, at), within(np.where(paras, text, 0), last, at),
    ]
    names = [f.split(":")[0] for f in _SUMS[len("struct<") : -1].split(",")]
    values = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], names)
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), values)


def with_starts(parsed: DataFrame) -> DataFrame:
    """Adds `starts`: the tokens that start an element, each with `s`, the sums over its element (see `_sums`)."""

    def code(t: Column) -> Column:
        flag = lambda c, bit: F.when(c, bit).otherwise(0)
        found = F.lit(_START) + flag(t["tag"] == "p", _P) + flag(t["tag"].rlike("^h[1-6]$"), _H)
        return F.struct(
            t["pos"].alias("pos"),
            t["end_pos"].alias("end_pos"),
            F.when(t["kind"] == "start", found).otherwise(0).alias("code"),
            F.coalesce(F.length(strip(t["text"])), F.lit(0)).alias("length"),
        )

    tokens = F.coalesce("tokens", F.array().cast(TOKENS))
    sums = F.arrow_udf(_sums, f"array<{_SUMS}>")(F.transform(tokens, code))
    both = F.zip_with("tokens", "_sums", lambda t, s: F.when(t["kind"] == "start", t.withField("s", s)))
    return parsed.withColumn("_sums", sums).withColumn("starts", F.filter(both, lambda t: t.isNotNull())).drop("_sums")


def _candidates(starts: Column, selectors: Sequence[str]) -> Column:
    """ARRAY of one STRUCT per selector: its first node and that node's counts (the node itself not counted)."""

    def described(s: Column, node: Column) -> Column:
        return F.struct(
            s["rank"].alias("selector_rank"),
            s["selector"].alias("selector"),
            node["pos"].alias("pos"),
            node["end_pos"].alias("end_pos"),
            node["s"].alias("c"),
        )

    return F.transform(
        _selector_array(selectors),
        lambda s: let(_first(starts, lambda t: _selects(t, s)), lambda node: described(s, node)),
    )


def container_score(
    parsed: DataFrame, selectors: Sequence[str] = fixed.MAIN_CONTENT_SELECTORS, key: str = "page_id"
) -> DataFrame:
    """One row per page and selector that finds a substantial container, with its score."""
    rows = explode_once(with_starts(parsed), _candidates(F.col("starts"), selectors), key, item="x").select(key, "x.*")
    score = F.col("c.text_len") + F.col("c.n_elements") * 5 + F.col("c.n_p") * 10 + F.col("c.n_h") * 20
    return rows.filter("pos is not null and c.text_len >= 50 and c.n_elements >= 3").select(
        key, "selector_rank", "selector", "pos", "end_pos", "c.n_elements", "c.n_p", "c.n_h", "c.text_len", score.alias("score")
    )


def best_container(scores: DataFrame, key: str = "page_id") -> DataFrame:
    """The container with the highest score; on a tie the earlier selector stays."""
    return (
        scores.groupBy(key)
        .agg(F.max_by(F.struct("selector", "pos", "end_pos", "score"), F.struct("score", -F.col("selector_rank"))).alias("b"))
        .select(key, "b.*")
    )


def _para_div(starts: Column) -> Column:
    """STRUCT(pos, end_pos) of the div with most paragraph text, of those with over 2 paragraphs and 200 characters.

    Nested paragraphs count once per enclosing paragraph: text is counted per paragraph node.
    """
    good = F.filter(starts, lambda t: (t["tag"] == "div") & (t["s"]["paras"] > 2) & (t["s"]["para_len"] > 200))
    best = F.array_max(
        F.transform(good, lambda t: F.struct(t["s"]["para_len"].alias("n"), (-t["pos"]).alias("f"), t["end_pos"].alias("e")))
    )
    return let(best, lambda b: F.when(b.isNotNull(), F.struct((-b["f"]).alias("pos"), b["e"].alias("end_pos"))))


def para_fallback(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """Per page the div with the most paragraph text, if one qualifies."""
    return with_starts(parsed).select(key, _para_div(F.col("starts")).alias("d")).filter("d is not null").select(key, "d.*")


def good_container(parsed: DataFrame, selector: str = "article", key: str = "page_id") -> DataFrame:
    """Whether the first node of a selector is good: over 1 element, 100 characters, 2 paragraphs with 100 characters."""
    chosen = F.element_at(_selector_array([selector]), 1)
    node = let(chosen, lambda s: _first(F.col("starts"), lambda t: _selects(t, s)))

    def judged(n: Column) -> Column:
        inner = F.slice("tokens", n["s"]["from"], F.coalesce(n["s"]["size"], F.lit(0)))
        paras = F.filter(inner, lambda t: F.contains(F.concat(t["path"], F.lit("/")), F.lit("/p/")))
        length = F.aggregate(paras, F.lit(0), lambda acc, t: acc + F.coalesce(F.length(strip(t["text"])), F.lit(0)))
        return F.struct(n.isNotNull().alias("found"), n["s"].alias("c"), length.alias("p_len"))

    rows = with_starts(parsed).select(key, let(node, judged).alias("j")).filter("j.found").select(key, "j.*")
    good = (F.col("c.n_elements") > 1) & (F.col("c.text_len") >= 100) & (F.col("c.n_p") >= 2) & (F.col("p_len") >= 100)
    return rows.select(key, good.alias("is_good"))


def _body(tokens: Column) -> Column:
    whole = F.struct(F.lit(0).alias("pos"), F.lit(2147483647).alias("end_pos"))
    return let(
        _first_tag(tokens, "body"),
        lambda n: F.when(n.isNotNull(), F.struct(n["pos"].alias("pos"), n["end_pos"].alias("end_pos"))).otherwise(whole),
    )


def main_content(parsed: DataFrame, selectors: Sequence[str] = fixed.MAIN_CONTENT_SELECTORS) -> DataFrame:
    """Adds `starts` (see `with_starts`), `body` and `main`, STRUCT(pos, end_pos): best-scored container, else the paragraph div, else the body."""
    located = with_starts(parsed)
    rows = located.withColumn("_c", _candidates(F.col("starts"), selectors))
    scored = F.transform(
        F.filter("_c", lambda x: x["pos"].isNotNull() & (x["c"]["text_len"] >= 50) & (x["c"]["n_elements"] >= 3)),
        lambda x: F.struct(
            (x["c"]["text_len"] + x["c"]["n_elements"] * 5 + x["c"]["n_p"] * 10 + x["c"]["n_h"] * 20).alias("score"),
            (-x["selector_rank"]).alias("rank"),
            x["pos"].alias("pos"),
            x["end_pos"].alias("end_pos"),
        ),
    )
    best = F.array_max(scored)
    rows = rows.withColumn("_best", best).withColumn("body", _body(F.col("tokens")))
    chosen = F.when(
        F.col("_best").isNotNull(), F.struct(F.col("_best.pos").alias("pos"), F.col("_best.end_pos").alias("end_pos"))
    ).otherwise(F.coalesce(_para_div(F.col("starts")), F.col("body")))
    return rows.withColumn("main", chosen).drop("_c", "_best")


# Markdown put where an element starts and where it ends.
_BLOCKS = ["p", "div", "ul", "ol", "table", "section", "article", "main", "figure"]
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "kbd": "`", "samp": "`", "del": "~~", "s": "~~"}
_OPEN = {
    **{t: "\n\n" for t in _BLOCKS},
    **{f"h{n}": "\n\n" + "#" * n + " " for n in range(1, 7)},
    **_MARKS,
    "br": "  \n", "hr": "\n\n---\n\n", "blockquote": "\n\n> ", "pre": "\n\n```\n", "td": "| ", "th": "| ", "tr": "\n",
}
_CLOSE = {
    **{t: "\n\n" for t in [*_BLOCKS, "blockquote", *[f"h{n}" for n in range(1, 7)]]},
    **_MARKS,
    "pre": "\n```\n\n", "td": " ", "th": " ", "tr": "|",
}


def _token_markdown(t: Column) -> Column:
    """What one token adds to the Markdown text."""
    start, tag = t["kind"] == "start", t["tag"]
    spaced = F.regexp_replace(t["text"], r"\s+", " ")
    text = (
        F.when(_has(t, IN_PRE), t["text"])
        .when(_has(t, IN_CODE), spaced)
        .otherwise(F.regexp_replace(spaced, r"([*_\\`])", r"\\$1"))
    )
    # list nesting: names in the path that are lists
    nesting = F.size(F.filter(F.split(t["path"], "/"), lambda p: p.isin("ul", "ol")))
    indent = F.repeat(F.lit("  "), F.greatest(nesting - 1, F.lit(0)))
    bullet = F.when(t["path"].endswith("/ol/li"), F.concat(t["nth"].cast("string"), F.lit(". "))).otherwise(F.lit("* "))
    link = (tag == "a") & (_attr(t, "href") != "")
    image = F.when(
        _attr(t, "src") != "",
        F.concat(F.lit("!["), F.coalesce(_attr(t, "alt"), F.lit("")), F.lit("]("), _attr(t, "src"), F.lit(")")),
    )
    opened = (
        F.when(tag == "li", F.concat(F.lit("\n"), indent, bullet))
        .when(link, F.lit("["))
        .when(tag == "img", image)
        .otherwise(F.try_element_at(constant_map(_OPEN), tag))
    )
    closed = F.when(link, F.concat(F.lit("]("), _attr(t, "href"), F.lit(")"))).otherwise(
        F.try_element_at(constant_map(_CLOSE), tag)
    )
    inside_pre = _has(t, IN_PRE) & (tag != "pre")
    return F.coalesce(
        F.when(t["kind"] == "text", text).when(inside_pre, F.lit("")).when(start, opened).otherwise(closed), F.lit("")
    )


def tokens_to_markdown(tokens: Column) -> Column:
    """Markdown of a token list in order; navigation, headers, footers, buttons and inputs are left out."""
    kept = F.filter(tokens, lambda t: ~_has(t, IN_UNCONVERTED))
    raw = F.array_join(F.transform(kept, _token_markdown), "")
    tidy = F.regexp_replace(raw, r"(?<=\n) (?=\S)", "")
    tidy = F.regexp_replace(tidy, r"[ \t]+(?=\n\n)", "")
    tidy = F.regexp_replace(tidy, r"\n(?:[ \t]*\n){2,}", "\n\n")
    # emphasis left empty by the page
    return F.regexp_replace(tidy, r"(?<!\*)\*\*\s*\*\*(?!\*)", "")


def to_markdown(parsed: DataFrame, region: str = "main") -> DataFrame:
    """Adds `markdown` of a region given as STRUCT(pos, end_pos)."""
    text = let(F.col(region), lambda r: tokens_to_markdown(_range(F.col("tokens"), r)))
    return parsed.withColumn("markdown", text)


def content_fallbacks(parsed: DataFrame) -> DataFrame:
    """`markdown` under 100 characters gives way to the body, then (only to something longer) to the text of the
    important tags; blank results are NULL. A node's tokens are cut out of the page's by their place, so the work grows with what is put out."""
    important = ["h1", "h2", "h3", "p", "ul", "ol", "table"]
    tokens = F.col("tokens")
    rows = parsed if "starts" in parsed.columns else with_starts(parsed)

    def short(text: Column) -> Column:
        return F.length(strip(text)) < 100

    def markdown_of(node: Column) -> Column:
        return tokens_to_markdown(_range(tokens, node))

    def direct(tag: Column) -> Column:
        nodes = F.filter("starts", lambda t: (t["tag"] == tag) & (t["s"]["text_len"] > 15))
        return F.transform(nodes, lambda n: tokens_to_markdown(F.slice(tokens, n["s"]["from"], n["s"]["size"])))

    def longer(first: Column) -> Column:
        direct_md = trim_code_head(F.array_join(F.flatten(F.transform(constant_array(important), direct)), "\n"))
        return F.when(
            short(first), let(direct_md, lambda d: F.when(F.length(d) > F.length(first), d).otherwise(first))
        ).otherwise(first)

    body = let(F.col("body"), markdown_of)
    first = let(F.col("markdown"), lambda m: F.when(short(m), body).otherwise(m))
    final = let(trim_code_head(first), longer)
    return rows.withColumn("markdown", F.nullif(strip(final), F.lit("")))


def clean_tokens(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Parsed, stripped, links absolute: what the content jobs start from."""
    return absolutize_links(strip_nodes(parse_pages(pages, html)), base_url(F.col(url)))


def page_text(pages: DataFrame, rules: Sequence[tuple[str, str]] | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """Pages to `page_type`, `markdown` and `error`; a page that fails has NULL text and an error."""
    typed = pages.withColumn("page_type", page_type(F.col(url), rules) if rules is not None else page_type(F.col(url)))
    content = content_fallbacks(to_markdown(main_content(clean_tokens(typed, url, html))))
    return content.withColumn("markdown", F.when(F.col("error").isNull(), F.col("markdown"))).drop("tokens", "starts", "body", "main")
