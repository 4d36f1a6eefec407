"""Repair of conversations: the cheapest edits that make the roles alternate and drop broken turns.

Wanted are role initials of the form (s?(ua)+)?. A row is kept for nothing, given the role user or
assistant for 3, or deleted for 4; a turn without text is inserted anywhere for 3. Blank and repeated
rows must be deleted, and a truncated row that stays costs 3 more. A repair is written as its audit, the
initials of its edits (K, R, D, I) in order; of the cheapest the least in ASCII order counts. As R and I
give the only role that fits, an audit says all.

The form has four states (nothing yet, s, an open u, complete pairs). The fold goes over the sorted turns
with aggregate(), carrying for each state the least (cost, audit) by native least expressions. It can be
cut anywhere: a long conversation is dealt into chunks of CHUNK rows, each is folded once per state it
might be entered in, and chunks are then joined, CHUNK at a time, level by level. So no row, array or
task holds more than a chunk of turns, also if one conversation has a third of all rows; only its audit
is one string, a character per edit.

Order: by turn (nulls first), then role and text. Rows are sorted by range over the whole table, so a
conversation may lie in many tasks, and a row's place there is its number.

Results for odd inputs: null roles and texts are one space, so such rows are blank or have a role to
change. Equal rows (same conversation, turn, role, text) travel as one with their number; all but the
first are duplicates. A null conversation id is a conversation. A conversation all of whose rows have
to go has cost 4 a row and the empty repair. An empty table gives no rows. Of the input only conv_id,
turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.shared import WORD, forget, written

#: Turns a fold takes at most, and chunks a join of chunks takes at most.
CHUNK = 64
STATES = (0, 1, 2, 3)
_NEVER = 1 << 40
_BEST = "struct<cost: bigint, audit: string>"
_TURNS = "array<struct<role: string, text: string>>"
#: A text whose last character that isn't a blank ends a sentence.
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"
#: Parts into which the rows of a repeated turn are dealt when they learn of its first.
SALTS = 16


def damaged(turns: DataFrame) -> DataFrame:
    """turns broken in known ways by crc32 of "conv_id:turn", modulo 20: 0 drops a row, 1 empties it, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), times.alias("times"))
    return rows.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")


# --- The fold -------------------------------------------------------------------------------------


def _best(cost: Column, audit: Column) -> Column:
    return F.struct(cost.alias("cost"), audit.alias("audit"))


def _plus(best: Column, cost: Column | int, edit: Column) -> Column:
    """A way with one more edit."""
    return _best(best["cost"] + cost, F.concat(best["audit"], edit))


def _inserted(s: list[Column]) -> list[Column]:
    """States after turns were inserted, or not: a user's opens a pair, an assistant's closes it."""
    opened = F.least(s[2], *[_plus(s[k], 3, F.lit("I")) for k in (0, 1, 3)])
    return [s[0], s[1], opened, F.least(s[3], _plus(opened, 3, F.lit("I")))]


def _stepped(s: list[Column], row: Column) -> list[Column]:
    """States after a row, before insertions."""
    fee = F.when(row["truncated"], 3).otherwise(0)
    kept = lambda role, k: _plus(s[k], F.when(~row["must"] & (row["initial"] == role), fee).otherwise(_NEVER), F.lit("K"))
    changed = lambda k: _plus(s[k], F.when(~row["must"], fee + 3).otherwise(_NEVER), F.lit("R"))
    gone = lambda k: _plus(s[k], 4, F.lit("D"))
    return [
        gone(0),
        F.least(gone(1), kept("s", 0)),
        F.least(gone(2), *[way for k in (0, 1, 3) for way in (kept("u", k), changed(k))]),
        F.least(gone(3), kept("a", 2), changed(2)),
    ]


def _equals_deleted(s: list[Column], row: Column) -> list[Column]:
    """States after the rows equal to one, which can only be deleted."""
    more = (row["times"] - 1).cast("int")
    return [_plus(way, 4 * more, F.repeat(F.lit("D"), more)) for way in s]


def _packed(ways: list[Column]) -> Column:
    return F.struct(*[w.alias(f"s{k}") for k, w in enumerate(ways)])


def _each(packed: Column, change: Callable[[list[Column]], list[Column]]) -> Column:
    """change of the four states, with their struct bound to a name: an expression that is used often is evaluated as often."""
    return F.transform(F.array(packed), lambda p: _packed(change([p[f"s{k}"] for k in STATES])))[0]


def folded(rows: Column, state: int) -> Column:
    """The least (cost, audit) for each state, s0 to s3, after sorted rows that are entered in one state."""
    start = [_best(F.lit(0 if k == state else _NEVER), F.lit("")).cast(_BEST) for k in STATES]

    def step(acc: Column, row: Column) -> Column:
        after = _each(acc, lambda s: _stepped(s, row))
        return _each(F.when(row["times"] > 1, _each(after, lambda s: _equals_deleted(s, row))).otherwise(after), _inserted)

    # path has the state each chunk is entered in; within a chunk there is one.
    found = F.aggregate(rows, _each(_packed(start), _inserted), step)
    return F.transform(F.array(found), lambda f: _packed([F.struct(f[f"s{k}"]["cost"], f[f"s{k}"]["audit"], F.lit(str(state)).alias("path")) for k in STATES]))[0]


def joined(chunks: Column, state: int) -> Column:
    """folded() over sorted chunks instead of rows; each has what folded() gives per entry state, e0 to e3."""
    start = [F.struct(F.lit(0 if k == state else _NEVER).cast("long").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("path")) for k in STATES]

    def through(s: list[Column], chunk: Column, out: int) -> Column:
        ways = [chunk[f"e{k}"][f"s{out}"] for k in STATES]
        return F.least(*[F.struct((a["cost"] + w["cost"]).alias("cost"), F.concat(a["audit"], w["audit"]).alias("audit"), F.concat(a["path"], w["path"]).alias("path")) for a, w in zip(s, ways, strict=True)])

    return F.aggregate(chunks, _packed(start), lambda acc, chunk: _each(acc, lambda s: [through(s, chunk, out) for out in STATES]))


# --- Rows, chunks, conversations ------------------------------------------------------------------


def numbered(turns: DataFrame) -> DataFrame:
    """Distinct rows with times and ord: rising in conv_id, turn (nulls first), role, text over the whole table."""
    text = lambda name: F.coalesce(F.col(name), F.lit(" ")).alias(name)
    rows = turns.select("conv_id", "turn", text("role"), text("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times"))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id())


def flagged(rows: DataFrame) -> DataFrame:
    """numbered() rows with blank, repeated, truncated (each row's first fault counts), must and initial.

    The first of equal turns is found by a partial aggregation and joined back in SALTS parts, so equal turns don't meet in one task."""
    said = rows.withColumn("digest", F.sha2("text", 256)).withColumn("blank", ~F.col("text").rlike(WORD))
    firsts = said.where("NOT blank").groupBy("conv_id", "role", "digest").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n > 1")
    parts = firsts.select(F.struct("conv_id", "role", "digest").alias("said"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    dealt = said.withColumn("said", F.struct("conv_id", "role", "digest")).withColumn("part", F.pmod(F.xxhash64("ord"), F.lit(SALTS)).cast("int"))
    met = dealt.join(parts, ["said", "part"], "left").withColumn("repeated", F.coalesce(F.col("ord") > F.col("first"), F.lit(False)))
    must = met.withColumn("must", F.col("blank") | F.col("repeated"))
    out = must.withColumn("truncated", ~F.col("must") & ~F.col("text").rlike(_ENDED)).withColumn("initial", F.left("role", F.lit(1)))
    return out.select("conv_id", "turn", "role", "text", "times", "ord", "blank", "repeated", "must", "truncated", "initial", F.expr(f"ord div {CHUNK}").alias("chunk"))


def _chunked(rows: DataFrame) -> DataFrame:
    """(conv_id, chunk, first and last turn and initial, counts, e0 to e3) of at most CHUNK rows each."""
    one = F.struct("ord", "turn", "initial", "times", "blank", "repeated", "truncated", "must")
    by = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    rows_ = F.col("rows")
    total = lambda f: F.aggregate(rows_, F.lit(0).cast("long"), lambda n, r: n + f(r))
    first, last = rows_[0], F.element_at(rows_, -1)
    turns = F.filter(F.transform(rows_, lambda r: r["turn"]), lambda t: t.isNotNull())
    flag = lambda c: F.when(c, 1).otherwise(0)
    # A row that stands for several has pairs with itself.
    inside = total(lambda r: (r["times"] - 1) * flag(_illegal(r["initial"], r["initial"])))
    pairs = F.zip_with(F.slice(rows_, 1, F.size(rows_) - 1), F.slice(rows_, 2, F.size(rows_)), lambda a, b: flag(_illegal(a["initial"], b["initial"])))
    return by.select(
        "conv_id",
        "chunk",
        total(lambda r: flag(r["blank"]) * r["times"]).alias("blank"),
        total(lambda r: F.when(r["blank"], 0).otherwise(r["times"] - 1 + flag(r["repeated"]))).alias("duplicate"),
        total(lambda r: flag(r["truncated"])).alias("truncated"),
        (inside + F.aggregate(pairs, F.lit(0).cast("long"), lambda n, x: n + x)).alias("illegal"),
        F.size(F.array_distinct(turns)).cast("long").alias("turns"),
        F.array_min(turns).alias("low"),
        F.array_max(turns).alias("high"),
        first["initial"].alias("first"),
        last["initial"].alias("last"),
        *[folded(rows_, k).alias(f"e{k}") for k in STATES],
    )


def _illegal(a: Column, b: Column) -> Column:
    return ~F.concat(a, b).isin("su", "ua", "au")


def _merged(chunks: DataFrame, whole: bool = False) -> DataFrame:
    """Chunks joined CHUNK at a time; whole: all of a conversation, of which there are CHUNK at most."""
    columns = [c for c in chunks.columns if c not in ("conv_id", "chunk")]
    keyed = chunks.withColumn("part", F.expr(f"chunk div {CHUNK}")) if not whole else chunks.withColumn("part", F.lit(0).cast("long"))
    by = keyed.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("chunk", *columns))).alias("c"))
    c = F.col("c")
    total = lambda f: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + f(x))
    a, b = F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c))
    across = lambda f: F.aggregate(F.zip_with(a, b, lambda x, y: F.when(f(x, y), 1).otherwise(0)), F.lit(0).cast("long"), lambda n, x: n + x)
    return by.select(
        "conv_id",
        F.col("part").alias("chunk"),
        *[total(lambda x, k=k: x[k]).alias(k) for k in ("blank", "duplicate", "truncated")],
        (total(lambda x: x["illegal"]) + across(lambda x, y: _illegal(x["last"], y["first"]))).alias("illegal"),
        (total(lambda x: x["turns"]) - across(lambda x, y: F.coalesce(x["high"] == y["low"], F.lit(False)))).alias("turns"),
        F.array_min(F.transform(c, lambda x: x["low"])).alias("low"),
        F.array_max(F.transform(c, lambda x: x["high"])).alias("high"),
        c[0]["first"].alias("first"),
        F.element_at(c, -1)["last"].alias("last"),
        *[joined(c, k).alias(f"e{k}") for k in ((0,) if whole else STATES)],
    )


def repairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of flagged() rows: one row per conversation (faults, cost, audit, path) and the chunks it came from."""
    chunks = written(_chunked(rows), "chunks")
    level = chunks
    while True:
        most = level.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n
        if most is None or most <= CHUNK:
            break
        level, before = written(_merged(level), "merged"), level
        if before is not chunks:
            forget(before)
    found = _merged(level, whole=True)
    # Whatever is open at the end can't be: nothing, or complete pairs.
    best = F.least(*[F.struct(F.col("e0")[f"s{k}"]["cost"].alias("cost"), F.col("e0")[f"s{k}"]["audit"].alias("audit"), F.col("e0")[f"s{k}"]["path"].alias("path"), F.lit(k).alias("end")) for k in (0, 3)])
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    out = found.withColumn("best", best).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", "best.path", "best.end")
    return out, chunks


def repaired_chunks(rows: DataFrame, found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(conv_id, chunk, turns): the turns of the cheapest repair, struct(role, text), per chunk of rows in order.

    A conversation's path has the state each of its chunks is entered in, so every chunk finds its part of the audit by itself."""
    key = F.struct("conv_id").alias("conv")
    path = F.concat("path", F.col("end").cast("string"))
    places = chunks.groupBy(key).agg(F.array_sort(F.collect_list("chunk")).alias("places"))
    entries = found.select(key, path.alias("path")).join(places, "conv").select("conv", "path", F.posexplode("places").alias("at", "chunk"))
    entries = entries.select("conv", "chunk", *[F.substring("path", F.col("at") + k, F.lit(1)).cast("int").alias(n) for k, n in ((1, "entry"), (2, "leave"))])
    ways = F.array(*[F.array(*[F.col(f"e{k}")[f"s{out}"]["audit"] for out in STATES]) for k in STATES])
    audits = chunks.select(key, "chunk", ways.alias("ways")).join(entries, ["conv", "chunk"]).select("conv", "chunk", "entry", F.col("ways")[F.col("entry")][F.col("leave")].alias("audit"))
    texts = rows.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct("ord", "role", "text", "initial", "times"))).alias("rows"))
    return texts.join(audits, ["conv", "chunk"]).select("conv.conv_id", "chunk", edited(F.col("rows"), F.col("audit"), F.col("entry") == 2).alias("turns"))


def edited(rows: Column, audit: Column, unanswered: Column) -> Column:
    """The turns that an audit makes of sorted rows; unanswered: whether a user's turn is open before them."""
    one_each = F.flatten(F.transform(rows, lambda r: F.array_repeat(r, r["times"].cast("int"))))
    parts = F.regexp_extract_all(audit, F.lit("(I*[KRD])"), F.lit(1))
    said = lambda n: F.when(n % 2 == 0, "user").otherwise("assistant")
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    # n counts users' and assistants' turns, from 1 where one is open: they alternate, so it says who is next.
    inserted = lambda n, k: F.transform(F.array_repeat(F.lit(""), k), lambda text, i: turn(said(n + i), text))
    start = F.struct(unanswered.cast("int").alias("n"), F.array().cast(_TURNS).alias("turns"))

    def step(acc: Column, pair: Column) -> Column:
        edit, row, k = F.right(pair["part"], F.lit(1)), pair["row"], F.length(pair["part"]) - 1
        role = F.when(edit == "K", row["role"]).otherwise(said(acc["n"] + k))
        own = F.when(edit != "D", F.array(turn(role, row["text"]))).otherwise(F.array().cast(_TURNS))
        counts = F.when((edit == "D") | ((edit == "K") & (row["initial"] == "s")), 0).otherwise(1)
        return F.struct((acc["n"] + k + counts).alias("n"), F.concat(acc["turns"], inserted(acc["n"], k), own).alias("turns"))

    done = F.aggregate(F.zip_with(one_each, parts, lambda r, p: F.struct(r.alias("row"), p.alias("part"))), start, step)
    tail = F.length(F.regexp_extract(audit, r"(I*)\z", 1))
    return F.transform(F.array(done), lambda d: F.concat(d["turns"], inserted(d["n"], tail)))[0]


def digest(turned: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired_chunks(): role:text lines, streamed chunk by chunk in sorted partitions, as a digest can't be split."""
    lines = turned.where(F.size("turns") > 0).select("conv_id", "chunk", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n").alias("lines"))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests, now, sha = [], [], None, None
        for batch in batches:
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                if sha is None or conv != now:
                    if sha is not None:
                        ids.append(now)
                        digests.append(sha.hexdigest())
                    now, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(text.encode())
            if len(ids) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("conv_id").type), pa.array(digests)], ["conv_id", "repaired_sha256"])
                ids, digests = [], []
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([*ids, now], batch.schema.field("conv_id").type), pa.array([*digests, sha.hexdigest()])], ["conv_id", "repaired_sha256"])

    kind = lines.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repaired(turns: DataFrame) -> DataFrame:
    """One row per conversation of turns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = written(flagged(written(numbered(turns), "numbered")), "flagged")
    found, chunks = repairs(rows)
    found = written(found, "repairs")
    shas = digest(repaired_chunks(rows, found, chunks)).withColumnRenamed("conv_id", "_conv")
    met = found.drop("path", "end").join(shas, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return met.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


def with_lost(results: DataFrame, conversations: DataFrame) -> DataFrame:
    """results, and for conversations that have no rows left: zeros, no edits, the empty text."""
    ids = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    met = ids.join(results, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select(F.col("_conv").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
