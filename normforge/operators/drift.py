"""Schemas that drift between the files of a feed.

Each file's schema is a tree: the root, its fields, and below object-typed fields their members.
For every file and the one before it in its feed the cheapest edit script between the two trees is
found, made of add, delete, rename, move and retype steps on fields and on members at any depth down to
``DEPTH``. A rename or a move is cheap when the new node carries on the old one's values for the same
products, beyond what chance would give; an object costs what its members cost. The nodes that
ended and those that began are assigned to each other at the least cost, their members then likewise.
The scripts are compiled into a projection per file, which brings all files into one table.

Records are parsed once, into a stored table of nodes. Only schema trees (bounded by the number of
fields of a file, not by its rows) and counts of equal values meet in a script; the values
themselves are compared by joins on (feed, file, product), and only those of nodes that ended or began.
The preceding file is found in blocks of file numbers, so that a feed holding a third of all files
is not sorted by one task.

Steps on members have the kinds ``member_added``, ``member_removed``, ``member_renamed`` and
``member_retyped``; a field or member that goes on under another parent is ``moved``, beside the
``removed`` and ``added`` of a field. Members are named by JSON pointers.

Defined results: null, malformed and non-object ``attrs`` have no fields, and a repeated key makes
the text malformed; a file delivered twice counts once; a node whose values differ in type within
a file is ``mixed``; null product ids are no evidence of a rename; records with a null feed or file
number belong to no file; numbers are carried on if they differ by at most ``CLOSE`` of their size, however written; members below
``DEPTH`` belong to their parent's value; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normforge.session import stored

#: Cost of adding or deleting a node, of another parent, of another type, and part of a field's cost that a member has.
ADD, DELETE, MOVE, RETYPE, MEMBER = 0.6, 0.6, 0.3, 0.2, 0.5
#: Part of a number by which it may change where a node carries it on.
CLOSE = 0.002
#: Levels of members below the fields.
DEPTH = 4
#: File numbers in a block of the search for the preceding file.
BLOCK = 512
#: Repeated doubling of rename chains ends here at the latest: chains of 2 ** 40 renames.
DOUBLINGS = 40
#: Begins the path of a member, a JSON pointer, so that no field's name can be taken for one.
POINTER = "\x01"


def _step(key: Column) -> Column:
    return F.concat(F.lit("/"), F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def attribute_rows(df: DataFrame) -> DataFrame:
    """(feed, file_seq, file_id, product_id, path, json_type, value) of every non-null field and member, stored.

    The path of a field is its name, that of a member its JSON pointer after POINTER.
    """
    keys = ["feed", "file_seq", "file_id", "product_id"]
    parsed = df.select("feed", F.col("file_seq").cast("long").alias("file_seq"), "file_id", "product_id", F.try_parse_json("attrs").alias("value")).where("value is not null and feed is not null and file_seq is not null")
    parsed = parsed.where("schema_of_variant(value) like 'OBJECT%'")

    def exploded(nodes: DataFrame, *keep: str) -> DataFrame:
        view = f"_attrs_{id(nodes)}"
        nodes.createOrReplaceTempView(view)
        out = df.sparkSession.sql(f"select {', '.join((*keys, *keep))}, e.key as key, to_json(e.value) as value from {view}, lateral variant_explode(value) as e where not is_variant_null(e.value)")
        df.sparkSession.catalog.dropTempView(view)
        return out

    fields = stored(typed(exploded(parsed).withColumnRenamed("key", "path")))
    levels, above = [fields], fields
    for _ in range(DEPTH):
        above = above.where("json_type = 'object'")
        if above.isEmpty():
            break
        members = exploded(above.withColumn("value", F.parse_json("value")), "path")
        parent = F.when(F.col("path").startswith(POINTER), F.col("path")).otherwise(F.concat(F.lit(POINTER), _step(F.col("path"))))
        above = stored(typed(members.select(*keys, F.concat(parent, _step(F.col("key"))).alias("path"), "value")))
        levels.append(above)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def typed(nodes: DataFrame) -> DataFrame:
    """Adds the JSON type of a JSON text."""
    first = F.substring("value", 1, 1)
    kind = F.when(first == '"', "string").when(first == "{", "object").when(first == "[", "array").when(first.isin("t", "f"), "boolean").otherwise("number")
    return nodes.withColumn("json_type", kind)


def file_fields(rows: DataFrame) -> DataFrame:
    """(feed, file_seq, file_id, path, json_type): the schema tree of each file."""
    kinds = rows.groupBy("feed", "file_seq", "file_id", "path").agg(F.min("json_type").alias("low"), F.max("json_type").alias("high"))
    return kinds.select("feed", "file_seq", "file_id", "path", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("mixed").alias("json_type"))


def preceding(files: DataFrame) -> DataFrame:
    """Adds ``prev_seq``, the greatest smaller file number of the feed."""
    seqs = files.select("feed", "file_seq").distinct().withColumn("block", F.floor(F.col("file_seq") / BLOCK))
    inside = Window.partitionBy("feed", "block").orderBy("file_seq")
    seqs = seqs.withColumn("prev_in", F.lag("file_seq").over(inside))
    blocks = seqs.groupBy("feed", "block").agg(F.max("file_seq").alias("last"))
    blocks = blocks.withColumn("prev_out", F.lag("last").over(Window.partitionBy("feed").orderBy("block"))).select("feed", "block", "prev_out")
    return seqs.join(blocks, ["feed", "block"]).select("feed", "file_seq", F.coalesce("prev_in", "prev_out").alias("prev_seq"))


def assign(cost: np.ndarray) -> list[int]:
    """Column of each row in the cheapest assignment (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def parent_of(path: str) -> str:
    """Path of the parent, "" for the root."""
    if not path.startswith(POINTER):
        return ""
    steps = path[len(POINTER) + 1 :].split("/")
    return steps[0].replace("~1", "/").replace("~0", "~") if len(steps) == 2 else POINTER + "/" + "/".join(steps[:-1])


class Edits:
    """Cheapest script between two schema trees given as {path: json type}.

    ``carried`` has, for a node that ended and one that began, the share of values carried on, from 0 to 1.
    """

    def __init__(self, old: dict[str, str], new: dict[str, str], carried: dict[tuple[str, str], float]):
        self.old, self.new, self.carried = old, new, carried
        self.gone, self.came = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
        self.below_gone, self.below_came = self._children(self.gone), self._children(self.came)
        self.known: dict[tuple[str, str], float] = {}

    @staticmethod
    def _children(paths: list[str]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for p in paths:
            out.setdefault(parent_of(p), []).append(p)
        return out

    def aligned(self, gone: list[str], came: list[str]) -> list[tuple[str, str]]:
        """Pairs of the cheapest assignment of ended to begun nodes, deletions and additions being allowed."""
        n, m = len(gone), len(came)
        if not n or not m or not self.carried:
            return []
        cost = np.zeros((n + m, n + m))
        for i, g in enumerate(gone):
            cost[i, :m] = [self.cost(g, c) for c in came]
            cost[i, m:] = DELETE
        cost[n:, :m] = ADD
        return [(gone[i], came[j]) for i, j in enumerate(assign(cost)[:n]) if j < m]

    def cost(self, g: str, c: str) -> float:
        """Cost of letting c carry on g, with what lies below."""
        if (g, c) not in self.known:
            own = 2 * (1 - self.carried.get((g, c), 0.0))
            below, above = self.below_gone.get(g, []), self.below_came.get(c, [])
            if below and above:  # an object is as much alike as its members are
                pairs = self.aligned(below, above)
                free = DELETE * (len(below) - len(pairs)) + ADD * (len(above) - len(pairs))
                own = min(own, MEMBER * (sum(self.cost(*p) for p in pairs) + free))
            moved = MOVE if parent_of(g) != parent_of(c) and not (parent_of(g) in self.below_gone and parent_of(g) in self.gone and parent_of(c) in self.came) else 0.0
            self.known[g, c] = own + moved + (RETYPE if self.old[g] != self.new[c] else 0.0)
        return self.known[g, c]

    def paired(self) -> list[tuple[str, str]]:
        """Every (old, new) of the script's renames and moves."""
        gone, came = set(self.gone), set(self.came)
        # subtrees that ended and began, wherever they hang
        out = self.aligned([g for g in self.gone if parent_of(g) not in gone], [c for c in self.came if parent_of(c) not in came])
        for g, c in out:
            out += self.aligned(self.below_gone.get(g, []), self.below_came.get(c, []))
        # what is left may have moved out of or into such a subtree
        done = {x for pair in out for x in pair}
        return out + self.aligned([g for g in self.gone if g not in done], [c for c in self.came if c not in done])

    def steps(self) -> list[tuple[str, str, str]]:
        """(kind, path, new path) of the whole script."""
        pairs = dict(self.paired())
        taken = {c: g for g, c in pairs.items()}

        def of(path: str, kind: str) -> str:
            return f"member_{kind}" if path.startswith(POINTER) else kind

        out = [(of(p, "retyped"), p, "") for p in sorted(self.old.keys() & self.new.keys()) if self.old[p] != self.new[p]]
        for g in self.gone:
            c = pairs.get(g)
            if c is None:
                out.append((of(g, "removed"), g, ""))
                continue
            above_g, above_c = parent_of(g), parent_of(c)
            if above_g == above_c:
                out.append((of(g, "renamed"), g, c))
            elif pairs.get(above_g) == above_c:
                if g.rsplit("/", 1)[-1] != c.rsplit("/", 1)[-1]:
                    out.append((of(g, "renamed"), g, c))
            else:
                out += [("moved", g, c), *([("removed", g, "")] if not above_g else []), *([("added", c, "")] if not above_c else [])]
            if self.old[g] != self.new[c]:
                out.append((of(g, "retyped"), g, ""))
        return out + [(of(c, "added"), c, "") for c in self.came if c not in taken]


def comparable(kind: Column, value: Column) -> Column:
    """Text by which values are told from each other: of numbers their value, of others their JSON."""
    number = value.try_cast("decimal(38,12)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(number, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(kind == "number", F.concat(F.lit("#"), F.coalesce(plain, value))).otherwise(value)


def carried_shares(rows: DataFrame, gone: DataFrame, came: DataFrame) -> DataFrame:
    """(feed, file_seq, old, new, share): agreement of the values by product, corrected for chance as Cohen's kappa is.

    gone and came: (feed, file_seq, at_seq, path) of nodes that ended and began, ``at_seq`` being the file that has them.
    """

    def values(fields: DataFrame, name: str) -> DataFrame:
        at = rows.where("product_id is not null").withColumnRenamed("file_seq", "at_seq").join(fields, ["feed", "at_seq", "path"])
        return at.groupBy("feed", "file_seq", "product_id", F.col("path").alias(name)).agg(F.min(F.xxhash64(comparable(F.col("json_type"), F.col("value")))).alias(f"{name}_value"), F.min(F.when(F.col("json_type") == "number", F.col("value").try_cast("double"))).alias(f"{name}_number"))

    old, new = values(gone, "old"), values(came, "new")
    met = stored(old.join(new, ["feed", "file_seq", "product_id"]).drop("product_id"))
    key = ["feed", "file_seq", "old", "new"]
    x, y = F.col("old_number"), F.col("new_number")
    equal = (F.col("old_value") == F.col("new_value")) | F.coalesce(F.abs(x - y) <= CLOSE * F.greatest(F.abs(x), F.abs(y)), F.lit(False))
    agreed = met.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if(equal).alias("same"))
    of_old = met.groupBy(*key, F.col("old_value").alias("v")).agg(F.count(F.lit(1)).alias("a"))
    of_new = met.groupBy(*key, F.col("new_value").alias("v")).agg(F.count(F.lit(1)).alias("b"))
    chance = of_old.join(of_new, [*key, "v"]).groupBy(*key).agg(F.sum(F.col("a") * F.col("b")).cast("double").alias("ab"))
    share = agreed.join(chance, key, "left").withColumn("p", F.col("same") / F.col("n")).withColumn("e", F.coalesce("ab", F.lit(0.0)) / (F.col("n") * F.col("n")))
    kappa = F.when(F.col("e") < 0.999, (F.col("p") - F.col("e")) / (1 - F.col("e"))).otherwise(F.col("p") * 0.71)
    return share.select(*key, F.greatest(kappa, F.lit(0.0)).alias("share"))


def schema_changes(df: DataFrame) -> DataFrame:
    """(feed, file_seq, file_id, field_name, change_kind, new_name) of every step of every file's edit script."""
    rows = attribute_rows(df)
    fields = file_fields(rows)
    ids = df.where("feed is not null and file_seq is not null").select("feed", F.col("file_seq").cast("long").alias("file_seq"), "file_id").distinct()
    files = preceding(ids).where("prev_seq is not null")
    later = fields.join(files, ["feed", "file_seq"]).groupBy("feed", "file_seq", "prev_seq", "path").agg(F.first("json_type").alias("new_type"))
    older = fields.withColumnRenamed("file_seq", "prev_seq").join(files, ["feed", "prev_seq"]).groupBy("feed", "file_seq", "prev_seq", "path").agg(F.first("json_type").alias("old_type"))
    both = stored(later.join(older, ["feed", "file_seq", "prev_seq", "path"], "full").where("old_type is null or new_type is null or old_type != new_type"))
    sides = F.count("old_type").over(Window.partitionBy("feed", "file_seq")).alias("old_n"), F.count("new_type").over(Window.partitionBy("feed", "file_seq")).alias("new_n")
    two_sided = both.where("old_type is null or new_type is null").select("*", *sides).where("old_n > 0 and new_n > 0")
    shares = carried_shares(
        rows,
        two_sided.where("new_type is null").select("feed", "file_seq", F.col("prev_seq").alias("at_seq"), "path"),
        two_sided.where("old_type is null").select("feed", "file_seq", F.col("file_seq").alias("at_seq"), "path"),
    )
    trees = both.groupBy("feed", "file_seq").agg(F.collect_list(F.struct("path", "old_type", "new_type")).alias("trees"))
    evidence = shares.groupBy("feed", "file_seq").agg(F.collect_list(F.struct("old", "new", "share")).alias("evidence"))

    def scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for feed, seq, tree, shares in zip(batch.feed, batch.file_seq, batch.trees, batch.evidence, strict=True):
                old = {t["path"]: t["old_type"] for t in tree if t["old_type"] is not None}
                new = {t["path"]: t["new_type"] for t in tree if t["new_type"] is not None}
                steps = Edits(old, new, {(s["old"], s["new"]): s["share"] for s in (shares if shares is not None else ())}).steps()
                out += [(feed, seq, p.removeprefix(POINTER) if k != "moved" else p, k, n.removeprefix(POINTER) if k != "moved" else n) for k, p, n in steps]
            yield pd.DataFrame(out, columns=["feed", "file_seq", "field_name", "change_kind", "new_name"])

    steps = trees.join(evidence, ["feed", "file_seq"], "left").mapInPandas(scripts, "feed string, file_seq long, field_name string, change_kind string, new_name string")
    return steps.join(ids, ["feed", "file_seq"]).select("feed", "file_seq", "file_id", "field_name", "change_kind", "new_name")


def renames_to_origin(changes: DataFrame) -> DataFrame:
    """(feed, field, from_seq, to_seq, origin): from file ``from_seq`` to before ``to_seq`` the field carries on ``origin``.

    Chains of renames are followed by pointer doubling, a logarithmic number of joins.
    """
    events = changes.where("change_kind in ('renamed', 'moved')").select("feed", F.col("file_seq").alias("seq"), F.col("field_name").alias("old"), F.col("new_name").alias("new")).distinct()
    events = events.withColumn("to_seq", F.lead("seq").over(Window.partitionBy("feed", "new").orderBy("seq")))
    events = stored(events)
    up = events.select(F.col("feed").alias("up_feed"), F.col("new").alias("up_new"), F.col("seq").alias("up_seq"), F.col("to_seq").alias("up_to"))
    follows = (F.col("feed") == F.col("up_feed")) & (F.col("old") == F.col("up_new")) & (F.col("up_seq") < F.col("seq")) & (F.col("up_to").isNull() | (F.col("up_to") >= F.col("seq")))
    linked = events.join(up, follows, "left")
    state = stored(linked.groupBy("feed", "new", "seq", "to_seq").agg(F.max("up_seq").alias("up_seq"), F.first("old").alias("origin")))
    for _ in range(DOUBLINGS):
        if state.where("up_seq is not null").isEmpty():
            break
        parents = state.select("feed", F.col("new").alias("origin"), F.col("seq").alias("up_seq"), F.col("up_seq").alias("next_seq"), F.col("origin").alias("next_origin"))
        state = stored(state.join(parents, ["feed", "origin", "up_seq"], "left").select("feed", "new", "seq", "to_seq", F.when(F.col("next_origin").isNull(), None).otherwise(F.col("next_seq")).alias("up_seq"), F.coalesce("next_origin", "origin").alias("origin")))
    return state.select("feed", F.col("new").alias("field"), F.col("seq").alias("from_seq"), "to_seq", "origin")


def _read(path: Column) -> Column:
    """What stands in ``attrs`` under a field's name or a member's pointer."""
    steps = F.transform(F.split(F.substring(path, len(POINTER) + 2, 1_000_000), "/"), lambda x: F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    found = F.try_element_at("attrs", steps[0])
    for k in range(1, DEPTH + 1):
        found = F.when(F.size(steps) > k, F.try_element_at(F.from_json(found, "map<string,string>"), F.get(steps, F.lit(k)))).otherwise(found)
    return F.when(path.startswith(POINTER), found).otherwise(F.try_element_at("attrs", path))


def conform(df: DataFrame, columns: list[tuple[str, str]], changes: DataFrame | None = None) -> DataFrame:
    """One table over all files: ``record_id, file_id, feed, file_seq`` and the given (name, JSON type) columns.

    Each file gets the projection its scripts compile to: renamed and moved fields are read under the name
    or pointer that carries them on, retyped values are taken out of a one-element array or one-member object
    and cast; what can't be cast is null. ``product_id`` comes from the record itself.
    """
    changes = schema_changes(df) if changes is None else changes
    origin = renames_to_origin(changes)
    wanted = [n for n, _ in columns if n != "product_id"]
    base = df.withColumn("file_seq", F.col("file_seq").cast("long"))
    files = base.select("feed", "file_seq").distinct()
    span = (F.col("s.file_seq") >= F.col("o.from_seq")) & (F.col("o.to_seq").isNull() | (F.col("s.file_seq") < F.col("o.to_seq")))
    projection = files.alias("s").join(origin.where(F.col("origin").isin(wanted)).alias("o"), (F.col("s.feed") == F.col("o.feed")) & span)
    # of a chain of names the last one begun holds
    projection = projection.groupBy("s.feed", "s.file_seq", "o.origin").agg(F.max_by("o.field", "o.from_seq").alias("field"))
    projection = projection.groupBy("feed", "file_seq").agg(F.map_from_entries(F.collect_list(F.struct("origin", "field"))).alias("names"))
    held = base.select("record_id", "file_id", "feed", "file_seq", "product_id", F.from_json("attrs", "map<string,string>").alias("attrs")).join(projection, ["feed", "file_seq"], "left")
    out = []
    for name, kind in columns:
        if name == "product_id":
            out.append(F.col("product_id"))
            continue
        raw = F.coalesce(_read(F.try_element_at("names", F.lit(name))), F.try_element_at("attrs", F.lit(name)))
        bag, row = F.from_json(raw, "map<string,string>"), F.from_json(raw, "array<string>")
        raw = F.when(raw.startswith("{") & (F.size(bag) == 1), F.map_values(bag)[0]).when(raw.startswith("[") & (F.size(row) == 1), row[0]).otherwise(raw)
        out.append(raw.try_cast({"number": "double", "boolean": "boolean"}.get(kind, "string")).alias(name))
    return held.select("record_id", "file_id", "feed", "file_seq", *out)
