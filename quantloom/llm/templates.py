"""Main text of web pages by deduced templates: tokens that share their occurrence vector over the pages of a host are its template.

A page is a sequence of tokens: opening and closing tags of block elements with
the way to them, the words of short texts, longer texts as a whole. Pages of a
host with one title count once. Then

1. a token's occurrence vector is how often it occurs on each page. Vectors are
   compared by sums of 128 bits over (page, count), which combine before a shuffle,
   so a host's pages never meet in one task. Tokens on at least SHARE of a host's
   pages are candidates; those with equal vectors form an equivalence class;
2. a class is valid as far as its tokens come in one order on all pages, and every
   instance of it lies within one gap of the host's root class (the largest whose
   tokens occur once a page); tokens that break the order leave the class. Valid
   classes nested into the gaps are the template;
3. what the template leaves of a page are its slots. Their texts are the data; of
   these the article is what no element or name marks as menu, header, footer,
   sidebar, notice, advert, form or comment.

Hosts with fewer than LEAST titles learn together, as one site.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, mix64, stored, tidily
from .html_blocks import Page, digest, new_root, read_page

LEAST = 4  # titles of a host that has a template of its own
SURE = 20  # titles beyond which the template also speaks within an article
SHARE = 0.9  # of a host's pages that hold a token of the template
TORN = 0.01  # of a class's pages on which a token may break order or nesting (cut pages)
UNITS = 256  # pages of a host that one row holds while learning
BROADCAST = 16 << 20  # bytes of templates that are broadcast; more are joined by host

HOST = "coalesce(lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '')"


def units(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, unit, tokens) of pages with a token; a unit stands for the pages of one title."""

    def run(batches):
        root, known = new_root(), {}
        for batch in batches:
            host, unit, tokens = [], [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = read_page(text or "", root, known)
                if page.tokens:
                    host.append(h)
                    unit.append(digest(page.title or text) - (1 << 63))
                    tokens.append(np.array(page.tokens, np.uint64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(unit, pa.int64()), pa.array(tokens, pa.binary())], names=["host", "unit", "tokens"])

    return pages.select(F.expr(HOST.format(f"`{url}`")).alias("host"), html).mapInArrow(tidily(run), "host string, unit long, tokens binary").groupBy("host", "unit").agg(F.min("tokens").alias("tokens"))


def _lists(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _candidates(batches):
    """Tokens on SHARE of a block's pages: a token on SHARE of a site's pages is one in some block."""
    for batch in batches:
        site, role = [], []
        for s, held in zip(_lists(batch, "site"), _lists(batch, "held"), strict=True):
            each = [np.unique(np.frombuffer(u["tokens"], np.uint64)) for u in held]
            found, n = np.unique(np.concatenate(each), return_counts=True)
            found = found[n >= SHARE * len(held)]
            site += [s] * len(found)
            role.append(found.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(site, pa.string()), pa.array(np.concatenate(role) if role else np.zeros(0, np.int64))], names=["site", "role"])


LANES = 4


def _vectors(batches):
    """(site, role, pages, total, place, l0..l3) of every block: on how many pages, how often, first places, and the sums that stand for the vector."""
    for batch in batches:
        columns = [[] for _ in range(4 + LANES)]
        site = []
        for s, held, roles in zip(_lists(batch, "site"), _lists(batch, "held"), _lists(batch, "roles"), strict=True):
            roles = np.sort(np.array(roles, np.int64))
            sums = np.zeros((3 + LANES, len(roles)), np.int64)
            for u in held:
                seq = np.frombuffer(u["tokens"], np.int64)
                found, first, n = np.unique(seq, return_index=True, return_counts=True)
                at = np.searchsorted(roles, found)
                at[at == len(roles)] = 0
                hit = roles[at] == found
                at, n = at[hit], n[hit]
                sums[0, at] += 1
                sums[1, at] += n
                sums[2, at] += first[hit]
                h = mix64(n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(u["unit"] & 0xFFFFFFFFFFFFFFFF))
                for k in range(LANES // 2):
                    sums[3 + 2 * k, at] += (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    sums[4 + 2 * k, at] += (h >> np.uint64(32)).astype(np.int64)
                    h = mix64(h + np.uint64(0xD6E8FEB86659FD93))
            site += [s] * len(roles)
            for k, x in enumerate([roles, *sums]):
                columns[k].append(x)
        arrays = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in columns]
        yield pa.RecordBatch.from_arrays([pa.array(site, pa.string()), *arrays], names=["site", "role", "pages", "total", "place", *(f"l{k}" for k in range(LANES))])


def _unordered(k: np.ndarray) -> np.ndarray:
    """Which of the steps lie outside a longest increasing sequence of them."""
    tails: list[int] = []
    ends: list[int] = []  # places in k of the tails
    back = [-1] * len(k)
    for i, x in enumerate(k.tolist()):
        j = bisect_left(tails, x)
        tails[j : j + 1] = [x]
        ends[j : j + 1] = [i]
        back[i] = ends[j - 1] if j else -1
    out = np.ones(len(k), bool)
    i = ends[-1] if ends else -1
    while i >= 0:
        out[i] = False
        i = back[i]
    return out


def _broken(batches):
    """(site, role, broken) of every block: the pages on which a token is out of its class's order, or in an instance that reaches over a token of the root class."""
    for batch in batches:
        site, which, count = [], [], []
        for s, held, classes in zip(_lists(batch, "site"), _lists(batch, "held"), _lists(batch, "classes"), strict=True):
            roles = [np.array(c["roles"], np.int64) for c in classes]
            all_roles = np.concatenate(roles)
            by = np.argsort(all_roles)
            names = all_roles[by]
            of = np.repeat(np.arange(len(roles)), [len(r) for r in roles])[by]
            step = np.concatenate([np.arange(len(r)) for r in roles])[by]
            size = np.array([len(r) for r in roles])
            once = np.array([not c["several"] for c in classes])
            bad = np.zeros(len(names), np.int64)
            for u in held:
                seq = np.frombuffer(u["tokens"], np.int64)
                at = np.searchsorted(names, seq)
                at[at == len(names)] = 0
                at = at[names[at] == seq]
                c, k = of[at], step[at]
                gap = np.cumsum(c == 0)  # class 0 is the root
                order = np.argsort(c, kind="stable")
                at, c, k, gap = at[order], c[order], k[order], gap[order]
                inside = np.arange(len(c)) - np.searchsorted(c, c)
                wrong = k != inside % size[c]
                for x in np.unique(c[wrong & once[c]]).tolist():
                    mine = np.flatnonzero(c == x)
                    wrong[mine] = _unordered(k[mine])
                later = np.flatnonzero((k > 0) & (c > 0) & ~wrong)
                wrong[later] |= gap[later] != gap[later - 1]
                bad[np.unique(at[wrong])] += 1
            site += [s] * len(names)
            which.append(names)
            count += bad.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(site, pa.string()), pa.array(np.concatenate(which) if which else np.zeros(0, np.int64)), pa.array(count, pa.int64())], names=["site", "role", "broken"])


def deduce(pages: DataFrame, url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(hosts, templates): (host, site, titles) of every host, and (site, class, pages, each, roles) of every valid class.

    ``roles`` are token roles in their order, ``each`` how often a page holds them.
    Both are stored tables. An empty table gives none.
    """
    held = stored(units(pages, url, html), "units")
    titles = held.groupBy("host").agg(F.count(F.lit(1)).alias("titles"))
    # a host's own name as site, with a letter before it; the empty site is that of all small hosts
    site = F.when(F.col("titles") >= LEAST, F.concat(F.lit("="), "host")).otherwise("")
    hosts = stored(titles.withColumn("site", site), "hosts")
    sites = hosts.groupBy("site").agg(F.sum("titles").alias("all"))
    block = F.pmod(F.col("unit"), F.ceil(F.col("all") / UNITS))
    blocks = stored(held.join(hosts.select("host", "site"), "host").join(sites, "site").groupBy("site", "all", block.alias("block")).agg(F.collect_list(F.struct("unit", "tokens")).alias("held")), "blocks")
    drop_stored(held)
    common = blocks.mapInArrow(tidily(_candidates), "site string, role long").distinct().groupBy("site").agg(F.collect_list("role").alias("roles"))
    lanes = [f"l{k}" for k in range(LANES)]
    sums = ["pages", "total", "place", *lanes]
    vectors = blocks.join(common, "site").mapInArrow(tidily(_vectors), "site string, role long, " + ", ".join(f"{c} long" for c in sums)).groupBy("site", "role").agg(*(F.sum(c).alias(c) for c in sums))
    frequent = vectors.join(sites, "site").filter(F.col("pages") >= SHARE * F.col("all"))
    one = F.sort_array(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("place"), "role")))
    classes = frequent.groupBy("site", "pages", "total", *lanes).agg(one.alias("found"), F.sum(F.col("role").bitwiseAND(1)).alias("tags"))
    # two tags, or three tokens of which one may be a tag, are a class
    classes = classes.filter((F.col("tags") >= 2) | (F.size("found") >= 3)).select("site", F.xxhash64(*lanes).alias("class"), "pages", (F.col("total") / F.col("pages")).alias("each"), F.col("found.role").alias("roles"))
    classes = stored(classes, "classes")
    first = F.sort_array(F.collect_list(F.struct((F.col("each") != 1).alias("several"), (-F.size("roles")).alias("n"), "class", "roles"))).alias("classes")  # the root class comes first
    judged = blocks.join(classes.groupBy("site").agg(first), "site").mapInArrow(tidily(_broken), "site string, role long, broken long").groupBy("site", "role").agg(F.sum("broken").alias("broken"))
    steps = classes.select("site", "class", "pages", "each", F.posexplode("roles").alias("step", "role")).join(judged, ["site", "role"])
    # a class without the tokens that break it; a class that comes several times a page stands or falls as a whole
    torn = F.col("broken") > TORN * F.col("pages")
    ordered = F.transform(F.sort_array(F.collect_list(F.when(~torn, F.struct("step", "role")))), lambda x: x["role"]).alias("roles")
    valid = steps.groupBy("site", "class", "pages", "each").agg(ordered, F.max(torn).alias("torn")).filter((F.size("roles") > 1) & ((F.col("each") == 1) | ~F.col("torn")))
    valid = stored(valid.drop("torn"), "templates")
    for t in (blocks, classes):
        drop_stored(t)
    return hosts, valid


def main_blocks(page: Page, template: frozenset[int], titles: int) -> list[str]:
    """Texts of the slots that are the article."""
    data, inside, main = [], False, False
    for b in page.blocks:
        if b.node.aside:
            continue
        if titles >= (SURE if b.node.article or b.node.main else LEAST):
            if all(t in template for t in page.tokens[b.first : b.last]):  # a block with any token in a slot stays whole
                continue
        data.append(b)
        inside |= b.node.article
        main |= b.node.main
    if inside:  # a heading before the article belongs to it
        return [b.text for b in data if b.node.article or b.node.main and b.node.name == "h1"]
    if main:
        return [b.text for b in data if b.node.main]
    return [b.text for b in data if not (b.node.name == "li" and 5 * b.linked >= 4 * len(b.text))]


@lru_cache(4096)
def _set(roles: bytes) -> frozenset[int]:
    return frozenset(np.frombuffer(roles, np.uint64).tolist())


def extract(pages: DataFrame, hosts: DataFrame, templates: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row, the text being the article's blocks joined by a line end."""
    tokens = templates.select("site", F.explode("roles").alias("role")).groupBy("site").agg(F.sort_array(F.collect_list("role")).alias("roles"))
    whole = hosts.join(tokens, "site", "left").select("host", "titles", "roles")
    n_bytes = int(whole.agg(F.sum(8 * F.greatest(F.size("roles"), F.lit(0)) + F.octet_length("host") + 64)).first()[0] or 0)
    asked = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), F.expr(HOST.format(f"`{url}`")).alias("host"))
    joined = asked.join(F.broadcast(whole) if n_bytes <= BROADCAST else whole, "host", "left").select("key", "url", "html", "titles", "roles")
    kind = dict(pages.dtypes)

    def run(batches):
        root, known = new_root(), {}
        for batch in batches:
            texts = []
            roles = batch.column(4)
            for k, (text, titles) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if not text:
                    texts.append("")
                    continue
                template = _set(np.asarray(roles[k].values).tobytes()) if roles[k].is_valid else frozenset()
                texts.append("\n".join(main_blocks(read_page(text, root, known), template, titles or 0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    return joined.mapInArrow(tidily(run), f"`{key}` {kind[key]}, `{url}` string, text string, n_chars long")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """:func:`deduce` and :func:`extract` in one: (key, url, text, n_chars), a row per row of ``pages``.

    A null or empty html gives an empty text; a null url is a host of its own. Rows
    that repeat, with any keys, are one page while learning and keep their rows.
    Very long pages are read whole. Other columns are not read; an empty table gives
    no rows.
    """
    hosts, templates = deduce(pages, url, html)
    return extract(pages, hosts, templates, key, url, html)
