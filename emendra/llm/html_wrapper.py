"""Main text of web pages by union-free regular-expression inference.

Pages of one host share a template. Each page's token stream is folded into a
union-free expression (repeated neighbours become one group), and the
expressions of a host are aligned one after another: what doesn't match becomes
optional, repeats become groups, and differing strings become text slots. The
idea is that of Crescenzi, Mecca and Merialdo, "RoadRunner" (2001); mismatches
are resolved on sibling sequences, so that the cost of a page doesn't explode.

A host's wrapper then decides:

* Slots that say the same on several different pages are template text. They
  have no weight, and where they stand in the main part they are left out,
  unless they are its title.
* Parts that are repeated groups of links are menus, and go likewise.
* The main part is what an element that is known for it holds (article, main,
  or a name), if that has a good share of the weight, which is unlinked varying
  text; else the deepest element that holds most of it, whatever its name.

Tags and names tell boilerplate that no wrapper can (comments, adverts that
change with the page), and are all there is on hosts of few pages.

A wrapper doesn't depend on the order or partitioning of the pages: pages of
one shape are summed up, which commutes, and shapes are aligned in an order of
their own, level by level, so a host with a third of all pages never meets in
one task. Wrappers are only sent around when their measured size allows it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emendra.llm.common import by_batch, durable, kept, map_arrow
from emendra.llm.html_names import MAIN_TAGS
from emendra.llm.html_tree import Node, read

#: Different pages on which a slot must say the same to be template text.
TEMPLATE_PAGES = 4
#: Nodes beyond which optional parts of a wrapper are known by their tags alone.
NODES = 2000
#: Shapes of a host that are aligned in one task, about.
SHAPES = 500

# A wrapper is a list [key, optional, repeated, pages, children], or for a slot
# ["#", optional, repeated, pages, least and greatest hash of its strings, characters, linked characters].
KEY, OPTIONAL, REPEATED, PAGES, REST = range(5)


def key_of(node: Node) -> str:
    """A node's name in a wrapper: its tag, its first two names without digits, and its mark."""
    names = ["".join(c for c in n if c.isalpha() or c in "_-") for n in node.names.split()[:2]] if node.names else []
    return ".".join([node.tag, *filter(None, names)]).replace("/", "") + node.mark


def _said(node: Node) -> str:
    return " ".join(node.text.split())


def _hash(said: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(said.encode("utf-8", "surrogatepass"))


def expression(node: Node) -> list:
    """A page's tree as a union-free expression."""
    if node.tag == "#":
        said = _said(node)
        h = _hash(said)
        return ["#", False, False, 1, h, h, len(said), node.linked]
    return [key_of(node), False, False, 1, fold([expression(c) for c in node.children])]


def fold(sequence: list) -> list:
    """Neighbours of the same key become one repeated node."""
    out: list = []
    for node in sequence:
        if out and out[-1][KEY] == node[KEY]:
            pages = max(out[-1][PAGES], node[PAGES])
            out[-1] = unify(out[-1], node)
            out[-1][REPEATED], out[-1][PAGES] = True, pages
        else:
            out.append(node)
    return out


def unify(a: list, b: list) -> list:
    """One node that stands for both, which have the same key."""
    head = [a[KEY], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], a[PAGES] + b[PAGES]]
    if a[KEY] == "#":
        return [*head, min(a[4], b[4]), max(a[5], b[5]), a[6] + b[6], a[7] + b[7]]
    return [*head, align(a[REST], b[REST])]


def align(a: list, b: list) -> list:
    """Two sibling sequences as one; what only one of them has becomes optional."""
    left, right = [x[KEY] for x in a], [x[KEY] for x in b]
    if left == right:
        return [unify(x, y) for x, y in zip(a, b)]
    out = []
    for kind, i, k, j, n in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [unify(x, y) for x, y in zip(a[i:k], b[j:n])]
        else:
            out += [[x[KEY], True, *x[REPEATED:]] for x in (*a[i:k], *b[j:n])]
    return fold(out)


def bare(key: str) -> str:
    """A key without names."""
    return key.partition(".")[0].rstrip("!?*") + (key[-1] if key[-1] in "!?*" else "")


def merge(wrapper: list | None, other: list) -> list:
    """Wrapper of all pages of both. Beyond NODES optional parts lose their names, then their order; no weight is lost."""
    merged = other if wrapper is None else unify(wrapper, other)
    for united in (False, True):
        if _count(merged) <= NODES:
            break
        merged = _coarser(merged, united)
    return merged


def _count(node: list) -> int:
    return 1 if node[KEY] == "#" else 1 + sum(map(_count, node[REST]))


def _coarser(node: list, united: bool) -> list:
    if node[KEY] == "#":
        return node
    children = [_coarser(c, united) for c in node[REST]]
    children = [[bare(c[KEY]), *c[1:]] if c[OPTIONAL] and c[KEY] != "#" else c for c in children]
    if united:
        children.sort(key=lambda c: c[KEY])
    return [*node[:REST], fold(children)]


def is_boilerplate(key: str, inside: bool = False) -> bool:
    """Whether a part of that key is boilerplate; `inside` a main part less is."""
    return key.endswith("!") or key.endswith("?") and not inside


def is_template(slot: list) -> bool:
    return slot[4] == slot[5] and slot[PAGES] >= TEMPLATE_PAGES


def _weight(node: list, inside: bool = False) -> int:
    """Unlinked varying text of a wrapper's part."""
    if node[KEY] == "#":
        return 0 if is_template(node) else max(0, node[6] - 2 * node[7])
    return 0 if is_boilerplate(node[KEY], inside) else sum(_weight(c, inside or _rank(node[KEY]) >= 0) for c in node[REST])


def _rank(key: str) -> int:
    """0 for article, 1 for main, 2 for names of a main part, -1 for others."""
    tag = key.partition(".")[0].rstrip("?*")
    return MAIN_TAGS.index(tag) if tag in MAIN_TAGS else 2 if key.endswith("*") else -1


def _is_menu(node: list) -> bool:
    """A repeated group of links on several pages."""
    chars = linked = 0
    repeated = False
    todo = [node]
    while todo:
        n = todo.pop()
        repeated = repeated or n[REPEATED]
        if n[KEY] == "#":
            chars, linked = chars + n[6], linked + n[7]
        else:
            todo += n[REST]
    return node[PAGES] >= TEMPLATE_PAGES and repeated and 0 < 0.9 * chars <= linked


#: What a wrapper says about a host: paths (keys joined by "/") of main parts, whether they are known as such, paths of menus, and template strings by path.
Plan = tuple[list[str], bool, list[str], dict[str, list[int]]]


def main_paths(wrapper: list) -> tuple[list[str], bool]:
    """Paths of the elements that hold the main text, and whether a tag or name says so."""
    named: list[tuple[int, int, str]] = []

    def walk(node: list, path: str) -> None:
        for child in node[REST]:
            if child[KEY] == "#" or is_boilerplate(child[KEY]):
                continue
            here = f"{path}/{child[KEY]}"
            rank = _rank(child[KEY])
            if rank >= 0 and (weight := _weight(child, True)) > 0:
                named.append((rank, weight, here))
            if rank != 0:
                walk(child, here)

    walk(wrapper, "")
    total = _weight(wrapper)
    for rank in range(3):
        found = [(w, p) for r, w, p in named if r == rank]
        if sum(w for w, _ in found) > 0.25 * total:
            # nested ones repeat what the outer ones hold
            return [p for _, p in found if not any(p.startswith(q + "/") for _, q in found)], True
    # no name says so: go down while one element holds most of the text
    node, path = wrapper, ""
    while True:
        inner = [(c, _weight(c)) for c in node[REST] if c[KEY] != "#"]
        best, weight = max(inner, key=lambda x: (x[1], x[0][KEY]), default=(None, 0))
        if best is None or not weight or best[REPEATED] or weight < 0.6 * _weight(node) or best[KEY].partition(".")[0] in ("p", "h1", "h2", "h3", "ul", "ol", "table"):
            return [path], False
        node, path = best, f"{path}/{best[KEY]}"


def plan_of(wrapper: list) -> Plan:
    """What to cut out of a page of this wrapper. If all of the main part is template text or menus, it says nothing about these."""
    paths, known = main_paths(wrapper)
    menus: list[str] = []
    said: dict[str, list[int]] = {}
    varies = False

    def look(node: list, path: str, inside: bool) -> None:
        nonlocal varies
        for child in node[REST]:
            here = f"{path}/{child[KEY]}"
            within = inside or here in paths or path in paths
            if child[KEY] == "#":
                if within and is_template(child):
                    said.setdefault(here, []).append(child[4])
                varies = varies or within and not is_template(child)
            elif not is_boilerplate(child[KEY], known and within):
                # a title is one even if all pages have the same
                if bare(child[KEY]).rstrip("?*") == "h1":
                    varies = varies or within
                elif within and here not in paths and _is_menu(child):
                    menus.append(here)
                else:
                    look(child, here, within)

    look(wrapper, "", "" in paths)
    return (paths, known, sorted(set(menus)), said) if varies else (paths, known, [], {})


def cut(page: Node, plan: Plan) -> str:
    """Main text of a page, by the places that its host's wrapper names."""
    paths, known, menus, said = plan
    wanted, dropped = set(paths), set(menus)

    def key_in(node: Node, path: str) -> str:
        """The path of a node, by its tag alone where the plan knows it so."""
        full = f"{path}/{key_of(node)}"
        if full in wanted or full in dropped:
            return full
        short = f"{path}/{bare(key_of(node))}"
        return short if short in wanted or short in dropped else full

    def walk(node: Node, path: str, inside: bool) -> Iterator[str]:
        for child in node.children:
            if child.tag == "#":
                if inside and not (said and (h := said.get(f"{path}/#")) and _hash(_said(child)) in h):
                    yield child.text
            elif not is_boilerplate(child.mark, known and inside):
                here = key_in(child, path)
                if here not in dropped or not inside:
                    yield from walk(child, here, inside or here in wanted)

    return " ".join(" ".join(walk(page, "", "" in wanted)).split())


def extract(page: str, plan: Plan | None) -> str:
    """Main text of a page; by its own expression if its host's wrapper finds none in it."""
    tree = read(page)
    return plan and cut(tree, plan) or cut(tree, plan_of(expression(tree)))


def host_column(url: str) -> Column:
    """The host of a URL, with its port if it names one, in lower case; null and empty ones have the host ""."""
    low = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[\p{Z}\s\x1c-\x1f\x85]+|[\p{Z}\s\x1c-\x1f\x85]+$", ""))
    return F.regexp_extract(F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?", ""), r"^[^/?#]*", 0)


def shape_of(wrapper: list) -> str:
    """An expression without its pages and strings."""
    return "#" if wrapper[KEY] == "#" else f"{wrapper[KEY]}{'+' if wrapper[REPEATED] else ''}({' '.join(map(shape_of, wrapper[REST]))})"


EXPRESSIONS = "host string, digest long, shape long, wrapper string"
LEARNT = "host string, shape long, pages long, wrapper string"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _expressions(rows: dict) -> dict:
    """Each page's expression, and digests of the page and the expression's shape."""
    out: dict[str, list] = {"host": [], "digest": [], "shape": [], "wrapper": []}
    for host, page in zip(rows["host"], rows["html"]):
        if page:
            own = expression(read(page))
            for name, value in zip(out, (host, _signed(_hash(page)), _signed(_hash(shape_of(own))), json.dumps(own, separators=(",", ":")))):
                out[name].append(value)
    return out


def _combine(keys: int, once: bool):
    """One row (host, shape, pages, wrapper) for neighbouring rows that agree in the first `keys` columns; the last two are pages or a digest, and a wrapper.

    With `once`, neighbours of one digest count once and different shapes are summed up side by side.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known: dict[tuple, list] = {}
        last = None

        def out() -> pa.RecordBatch:
            rows = [(k[0], k[1], w[PAGES], json.dumps(w, separators=(",", ":"))) for k, w in known.items()]
            known.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["host", "shape", "pages", "wrapper"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                if once:
                    if row[:2] == last:
                        continue
                    last, key = row[:2], (row[0], row[2])
                else:
                    key = row[:keys] if keys > 1 else (row[0], 0)
                    if known and key not in known:
                        yield out()
                wrapper = json.loads(row[-1])
                known[key] = merge(known.get(key), wrapper)
                if len(known) > 500:
                    yield out()
        if known:
            yield out()

    return run


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the inferred expression of each host of (host, html), as JSON.

    Equal pages of a host count once.
    """
    spark = pages.sparkSession
    made = by_batch(pages.select("host", "html"), _expressions, EXPRESSIONS, 64)
    # pages of one shape: their sums commute, so partial sums may come in any order
    dealt = made.repartition("host", "digest").sortWithinPartitions("host", "digest")
    partial = map_arrow(dealt, _combine(2, True), LEARNT)
    for salts in (64, 1):
        salted = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
        partial = map_arrow(salted.repartition("host", "shape", "salt").sortWithinPartitions("host", "shape", "salt").select("host", "shape", "pages", "wrapper"), _combine(2, False), LEARNT)
    shapes = durable(partial)
    # shapes of a host: aligned from the most to the least frequent, in parts that depend on their number alone
    counted = shapes.groupBy("host").agg((F.count(F.lit(1)) / SHAPES).cast("long").alias("parts"))
    parted = shapes.join(counted, "host").withColumn("part", F.pmod("shape", F.col("parts") + 1))
    aligned = map_arrow(_in_order(parted, "part").select("host", "part", "pages", "wrapper"), _combine(2, False), LEARNT)
    whole = map_arrow(_in_order(aligned.withColumnRenamed("shape", "part"), None).select("host", "part", "pages", "wrapper"), _combine(1, False), LEARNT)
    return whole.select("host", "wrapper")


def _in_order(rows: DataFrame, part: str | None) -> DataFrame:
    keys = ["host", part] if part else ["host"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("pages"), "shape" if part else "part")


def _plan(wrapper: str | None) -> Plan | None:
    """The plan of a wrapper; a worker remembers those it has seen."""
    if not wrapper:
        return None
    known = kept(("wrappers",), dict)
    if wrapper not in known:
        if len(known) > 2000:
            known.clear()
        known[wrapper] = plan_of(json.loads(wrapper))
    return known[wrapper]


def extract_main_text(pages: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(page_id, url, text, n_chars): each page's main text by its host's wrapper.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by one space. A null or empty page gives an empty
    text; pages without url form a host of their own; repeated rows give
    repeated results; an empty table an empty result; further columns are
    ignored. Neither the order nor the partitioning of pages matters. Wrappers
    are broadcast up to `broadcast_bytes`, else joined by host.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_column("url"))
    wrappers = durable(infer_wrappers(own))
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0))).first()[0]

    def work(rows: dict) -> dict:
        texts = [extract(page, _plan(wrapper)) if page else "" for page, wrapper in zip(rows["html"], rows["wrapper"])]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    joined = own.join(F.broadcast(wrappers) if size <= broadcast_bytes else wrappers, "host", "left")
    return by_batch(joined.select("page_id", "url", "html", "wrapper"), work, "page_id long, url string, text string, n_chars long", 64)
