"""Line dedup on content-defined chunks, in DataFrame functions only.

Lines are hashed; a rolling hash over each two neighbouring line hashes chooses where chunks end (at its local
minima), so an inserted or deleted line moves boundaries only nearby. No boundary closes a chunk of fewer than
two lines. A chunk that occurs again anywhere is repeated: its first place (least doc_id, then place) keeps
it, the others lose it. Around each lost chunk the lines of the two neighbouring chunks are compared with those
around its first place, one by one, and go too as far as they agree. Boundaries depend on four lines, so a passage
that holds a repeated chunk ends within two chunks of it, and goes to its ends though the chunks there differ. Whatever a loss rests on stays. Hashes only nominate; passages are removed after
their bytes have been compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import discard, join_counted, stored

def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns computed once: the generator keeps the optimizer from copying expressions into their uses."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def _split(df: DataFrame) -> DataFrame:
    """Adds `__lines`: the lines of `__text`. A null text has none."""
    return _held(df, __lines=F.coalesce(F.split("__text", "\n", -1), F.array().cast("array<string>")))


def _ended(df: DataFrame) -> DataFrame:
    """Adds `__ends`: for each chunk of `__lines`, the number of lines up to its end; and `__hashes` of the lines, odd for a blank line and even for any other."""
    df = _held(df, __hashes=F.transform("__lines", lambda x: F.when(_blank(x), F.xxhash64(x).bitwiseOR(F.lit(1))).otherwise(F.xxhash64(x).bitwiseAND(F.lit(-2)))))
    before, last = F.concat(F.array(F.lit(0).cast("long")), "__hashes"), F.size("__hashes") - 1
    df = _held(df, __rolled=F.zip_with(before, "__hashes", lambda a, b: F.xxhash64(a, b)))
    df = _held(df, __cut=F.transform("__rolled", lambda x, i: F.when(_may_end(x, i, last), x)))
    # A local minimum; of equal ones the earlier.
    left, right = (lambda i: F.when(i > 0, F.get("__cut", i - 1))), (lambda i: F.get("__cut", i + 1))
    stays = lambda x, i: x.isNotNull() & F.coalesce(x < left(i), F.lit(True)) & F.coalesce(x <= right(i), F.lit(True))
    return _held(df, __ends=F.filter(F.transform("__cut", lambda x, i: F.when(stays(x, i) | (i == last), i + 1)), lambda x: x.isNotNull())).drop("__rolled", "__cut")


def _may_end(rolled: Column, i: Column, last: Column) -> Column:
    """Whether a chunk may end behind line i: two lines at least before and after it."""
    return (i > 0) & (i < last - 1)


def chunked(df: DataFrame) -> DataFrame:
    """Adds `__chunks`: the chunks of `__text`, each an array of lines. A null text has none."""
    df = _ended(_split(df))
    starts = F.concat(F.array(F.lit(0)), "__ends")
    chunks = F.transform("__ends", lambda e, j: F.slice("__lines", F.get(starts, j) + 1, e - F.get(starts, j)))
    return _held(df, __chunks=chunks).drop("__lines", "__ends", "__hashes")


def _blank(line: Column) -> Column:
    return F.trim(line, F.lit("\n\t\r ")) == ""


def _body(start: Column, size: Column) -> Column:
    return F.array_join(F.slice("__lines", start + 1, size), "\n")


def _places(df: DataFrame) -> DataFrame:
    """One row per chunk of several lines, not all blank: its first line's number, its number of lines, the hash of its text, and the line hashes of the two chunks before it (from the last line back) and of the two after it, with how many of them belong to the nearer one."""
    df = _ended(_split(df))
    starts = F.concat(F.array(F.lit(0)), "__ends")
    cut = lambda a, b: F.coalesce(F.slice("__hashes", a + 1, b - a), F.array().cast("array<bigint>"))
    back = lambda j, n: F.get(starts, F.greatest(j - n, F.lit(0)))
    on = lambda j, n: F.get("__ends", F.least(j + n, F.size("__ends") - 1))
    found = F.transform("__ends", lambda e, j: F.struct(
        F.get(starts, j).alias("start"), (e - F.get(starts, j)).alias("size"), F.reverse(cut(back(j, 2), F.get(starts, j))).alias("before"), (F.get(starts, j) - back(j, 1)).alias("near_before"), cut(e, on(j, 2)).alias("after"), (on(j, 1) - e).alias("near_after"),
    ))
    df = df.select("__id", "__key", "__lines", F.inline(F.filter(found, lambda c: c["size"] > 1)))
    df = df.withColumn("body", _body(F.col("start"), F.col("size"))).drop("__lines").where("trim('\n\t\r ' FROM body) <> ''")
    return df.withColumn("hash", F.xxhash64("body")).drop("body")


def _is_first() -> Column:
    """Whether a place is the first of its kind."""
    return F.col("first")["__id"].eqNullSafe(F.col("__id")) & (F.col("first")["__key"] == F.col("__key")) & (F.col("start") == F.col("first")["start"])


def _agreed(own: str, other: str) -> Column:
    """How many leading hashes agree, not counting blank lines at the far end."""
    same = F.zip_with(own, other, lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = F.array_position(same, False).cast("int")
    n = F.when(n == 0, F.size(same)).otherwise(n - 1)
    marked = F.transform(F.slice(own, F.lit(1), n), lambda x, i: F.when(x.bitwiseAND(F.lit(1)) == 0, i + 1).otherwise(0))
    return F.coalesce(F.array_max(marked), F.lit(0))


def _facts(places: DataFrame, again: DataFrame) -> DataFrame:
    """Stored facts on repeated chunks by document: places that go, with the lines that go before and after them, and, for each first place, the extents of it that losses rest on."""
    named = join_counted(places, again, "hash", places.count()).dropDuplicates(["__id", "__key", "start"])
    order = Window.partitionBy("__id", "__key").orderBy("start")
    named = named.withColumn("gone", ~_is_first())
    chunk = F.struct(F.col("start"), (F.col("start") + F.col("size")).alias("end"), "gone")

    def open_part(hashes: str, near: str, f, at) -> Column:
        """The neighbouring hashes up to the first chunk that is lost itself; the two neighbours are at most two named places away."""
        lost = lambda distance: F.coalesce(f(chunk, 1).over(order)["gone"] & (at(f(chunk, 1).over(order)) == distance), F.lit(False)) | F.coalesce(f(chunk, 2).over(order)["gone"] & (at(f(chunk, 2).over(order)) == distance), F.lit(False))
        return F.when(lost(F.lit(0)), F.array().cast("array<bigint>")).when(lost(F.col(near)), F.slice(hashes, F.lit(1), F.col(near))).otherwise(F.col(hashes))

    before = open_part("before", "near_before", F.lag, lambda c: F.col("start") - c["end"])
    after = open_part("after", "near_after", F.lead, lambda c: c["start"] - F.col("start") - F.col("size"))
    named = named.select("__id", "__key", "start", "size", "hash", "first", "gone", before.alias("before"), after.alias("after"))
    named = stored(named, "line-named")
    firsts = named.where("NOT gone").select("hash", F.col("size").alias("f_size"), F.col("before").alias("f_before"), F.col("after").alias("f_after")).join(again.select("hash", "rows"), "hash")
    gone = named.where("gone").drop("gone")
    met = join_counted(gone, stored(firsts, "line-firsts"), "hash", gone.count())
    met = stored(met.select("__id", "__key", "start", "size", "f_size", "hash", "first", _agreed("before", "f_before").alias("more_before"), _agreed("after", "f_after").alias("more_after")), "line-gone")
    rests = met.select("first", F.col("f_size").alias("size"), "hash", "more_before", "more_after").distinct()
    both = met.select("__id", "__key", F.struct("start", "size", "hash", "more_before", "more_after", F.lit(True).alias("gone")).alias("c")).unionByName(
        rests.select("first.__id", "first.__key", F.struct("first.start", "size", "hash", "more_before", "more_after", F.lit(False).alias("gone")).alias("c"))
    )
    done = stored(both.groupBy(F.col("__id").alias("__n_id"), F.col("__key").alias("__n_key")).agg(F.sort_array(F.collect_set("c")).alias("__named")), "line-facts")
    discard(named, met)
    return done


_FACT = "array<struct<start:int,size:int,hash:bigint,more_before:int,more_after:int,gone:boolean>>"


def line_dedup(docs: DataFrame) -> DataFrame:
    """Remove repeated passages of several lines; every other column stays as it is.

    Returns one row per input row: its columns, with `text` without the removed lines, then n_lines and
    n_removed (long; input columns of these names are replaced). A null text has no lines and stays null;
    an empty text has one empty line. Of equal chunks, the one of the least doc_id (null first), then of the
    least text hash, then the earliest stays. Chunks of one line, or of
    blank lines only, are never nominated. A lost chunk takes along the lines of the two chunks on either side that
    agree with those at the first place, up to the last that isn't blank, unless they are lost themselves or a
    loss elsewhere rests on them: so each lost run of lines stands whole at a first place. Rows equal in
    doc_id and text count as one place and share their result. A text of any length is judged whole, within
    one row; other columns may have any names. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    key = [F.col("doc_id").cast("long").alias("__id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("__key")]
    # Input columns travel under names of their own, so that they may have any.
    own = [f"__c{i}" for i in range(len(names))]
    keyed = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True) if c != "text"), F.col("text").cast("string").alias("__raw"), *key)
    places = stored(_places(docs.select(*key, F.col("text").cast("string").alias("__text"))), "line-places")
    place = F.struct("__id", "__key", "start")
    again = stored(places.groupBy("hash").agg(F.count("*").alias("rows"), F.min(place).alias("first")).where("rows > 1"), "line-again")
    facts = _facts(places, again)
    # The facts grow with the documents, so they are never sent to all tasks.
    joined = stored(keyed.join(facts.hint("merge"), F.col("__id").eqNullSafe(F.col("__n_id")) & (F.col("__key") == F.col("__n_key")), "left").drop("__n_id", "__n_key"), "line-nominated")
    discard(places, again, facts)

    # Bytes are compared by grouping: texts that share hash and extent but differ fall into different groups.
    shown = _shown(joined).select("hash", "more_before", "more_after", "body")
    clashes = stored(shown.distinct().groupBy("hash", "more_before", "more_after").agg(F.count("*").alias("n")).where("n > 1").select("hash").distinct(), "line-clashes")
    if clashes.isEmpty():
        discard(clashes)
    else:
        joined = _without_clashes(joined, clashes, [o for c, o in zip(names, own, strict=True) if c != "text"])
    named = F.coalesce("__named", F.array().cast(_FACT))
    lines_of = lambda gone: F.flatten(F.transform(F.filter(named, lambda c: c["gone"] == gone), lambda c: F.sequence(c["start"] - c["more_before"], c["start"] + c["size"] + c["more_after"] - 1)))
    final = _held(_split(joined.withColumn("__text", F.col("__raw"))), __gone=F.array_except(lines_of(True), lines_of(False)))
    every = F.when(F.size("__lines") > 0, F.sequence(F.lit(0), F.size("__lines") - 1)).otherwise(F.array().cast("array<int>"))
    final = _held(final, __stay=F.array_except(every, "__gone"))
    kept = F.transform("__stay", lambda i: F.get("__lines", i))
    final = _held(final, __kept=F.when(F.col("__raw").isNotNull(), F.array_join(kept, "\n")), __n_lines=F.size("__lines").cast("long"), __n_kept=F.size("__stay").cast("long"))
    return final.select(*(F.col("__kept" if c == "text" else o).alias(c) for c, o in zip(names, own, strict=True)), F.col("__n_lines").alias("n_lines"), (F.col("__n_lines") - F.col("__n_kept")).alias("n_removed"))


def _shown(joined: DataFrame) -> DataFrame:
    """The nominated passages with their text."""
    texts = _split(joined.where("__named IS NOT NULL").select("__id", "__key", "__named", F.col("__raw").alias("__text")))
    texts = texts.select("__id", "__key", "__lines", F.explode("__named").alias("c")).select("__id", "__key", "__lines", "c", "c.*")
    return texts.select("__id", "__key", "c", "start", "size", "hash", "more_before", "more_after", "gone", _body(F.col("start") - F.col("more_before"), F.col("size") + F.col("more_before") + F.col("more_after")).alias("body"), _body(F.col("start"), F.col("size")).alias("chunk"))


def _without_clashes(joined: DataFrame, clashes: DataFrame, columns: list[str]) -> DataFrame:
    """Decide chunks whose hash belongs to different texts by those texts: the first place of each text keeps it, and the others lose the chunk alone."""
    shown = _shown(joined)
    own = shown.join(clashes, "hash").select("__id", "__key", "start", "size", "hash", "chunk").distinct()
    first = own.groupBy("hash", "chunk").agg(F.min(F.struct("__id", "__key", "start")).alias("first"))
    none = F.lit(0)
    decided = own.join(first, ["hash", "chunk"]).select("__id", "__key", F.struct("start", "size", "hash", none.alias("more_before"), none.alias("more_after"), (~_is_first()).alias("gone")).alias("c"))
    rest = shown.join(clashes, "hash", "left_anti").select("__id", "__key", "c")
    nominated = decided.unionByName(rest).groupBy(F.col("__id").alias("__n_id"), F.col("__key").alias("__n_key")).agg(F.sort_array(F.collect_set("c")).alias("__decided"))
    back = joined.join(nominated, F.col("__id").eqNullSafe(F.col("__n_id")) & (F.col("__key") == F.col("__n_key")), "left")
    return back.select(*columns, "__raw", "__id", "__key", F.col("__decided").alias("__named"))
