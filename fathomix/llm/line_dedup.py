"""Line dedup by a log-template tree, in DataFrame operations only.

A line's tokens are split at white space and tokens with a digit become the variable field <*>.  The
tree has a fixed depth: the number of tokens, then 3 to 5 tokens in a row, which lead to a leaf.  Those are the
leading tokens, or, below wildcard children for variable leading tokens, the ones that follow at one of
``PATHS`` places; so lines with other words in some of their fields meet in a leaf.  A line of fewer than ``SHORT`` tokens is
led by all of them but one, which has the wildcard, for each one in turn.

The template of a leaf has, at each place, the token that most of the leaf's lines hold there.  A line
belongs to it if it agrees token by token at ``match`` of the places or more; a leaf's other lines may
meet in another tree, so that one token count and opening has many templates.  A template recurs if its lines, and
a line if it itself, occur in at least ``min_texts`` different texts; copies of a whole document count as
one text.  A template of fewer than SHORT tokens must also occur ``LIFT`` times as often as its tokens would meet by chance, from
their shares among all lines of that length.  Recurring lines are dropped everywhere.

A line of 50 tokens or more recurs from two different texts on, of which near copies count as one: of a
pair of them, which near dedup decides on, neither loses the lines.  Lines of fewer than ``min_tokens``
tokens always stay, as do lines without a token; with ``EVERY_LINE`` all others count.  A line of one or
two variable fields has nothing constant, so it counts by its own tokens.

All decisions are a set of line hashes of 128 bits.  A table of hashes, one row a line, is all that is
shuffled of most lines; counts are aggregated before they shuffle, so that a line in a third of all
documents is one row for each map task.  The set is joined by hash, never collected.  The tokens of lines in leaves of
two or more different lines are cut once more, from one text each.

Defined cases: null stays null, empty stays empty; a text whose lines all go becomes the empty text;
rows that repeat an id keep their own texts; an empty table gives no rows; other columns pass through,
but for n_lines and n_dropped, which ``counts`` replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomix.storage import Scratch

MIN_TEXTS = 3
MIN_TOKENS = 3
#: For ``min_tokens``: lines of one or two tokens recur by the same rule as longer ones.
EVERY_LINE = 1
#: A line of so many tokens recurs from two texts on, unless they share so much of their sequences of 5 words.
LONG_TOKENS = 50
NEAR = 0.5
SHINGLE = 5
#: Places of a longer line from which tokens lead to a leaf, the first and the last included.
PATHS = 8
#: Lines of fewer tokens have one wildcard.
SHORT = 8
MATCH = 0.75
LIFT = 10

LINE = ["line", "check"]


def _plain(line: Column) -> Column:
    """A line's tokens with one blank between them."""
    return F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))


def _words(docs: DataFrame, text: str) -> DataFrame:
    """The other columns of docs with place and words of each line that has any: its masked tokens, apart by one blank.

    The words of a line of one or two variable fields are its own, behind a blank.
    """
    # A step each, as an expression that is named twice within a function is evaluated twice.
    text_ = F.col(text)
    blanks = r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*+|\x20[\x20\x09\x0B-\x0D]++"
    odd = F.contains(text_, F.lit("  "))
    for c in "\t\v\f\r":
        odd |= F.contains(text_, F.lit(c))
    even = F.when(odd, F.regexp_replace(text_, blanks, " ")).otherwise(text_)
    plain = F.transform(F.split(even, "\n"), lambda x: F.trim(x))

    def mask(x: Column) -> Column:
        masked = F.regexp_replace(x, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", "<*>")
        return F.when(F.rlike(x, F.lit("[0-9]")), F.when(masked.isin("<*>", "<*> <*>"), F.concat(F.lit(" "), x)).otherwise(masked)).otherwise(x)

    words = F.when(F.rlike(text_, F.lit("[0-9]")), F.transform(plain, mask)).otherwise(plain)
    others = [c for c in docs.columns if c != text]
    # An outer explode, as Spark would add a filter on the size of the array to the other, and build it twice.
    return docs.select(*others, words.alias("all")).select(*others, F.posexplode_outer("all").alias("place", "words")).filter("words <> ''")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"line": F.xxhash64("words"), "check": F.xxhash64(F.lit(1), F.col("words"))})


def _lines(docs: DataFrame, doc_id: str, text: str, min_tokens: int) -> DataFrame:
    """id, text_hash, place, line, check, n (tokens), leaves, which hold for lines of SHORT tokens or more, and words of
    shorter ones.  A line that counts by its own tokens has an n of 0 and no words.
    """
    rows = _words(docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")), "text")
    rows = _hashed(rows).withColumn("own", F.startswith("words", F.lit(" "))).withColumn("tokens", F.split("words", " ")).withColumn("size", F.size("tokens"))
    if min_tokens > 1:
        rows = rows.filter(F.when(F.col("own"), F.col("size") - 1).otherwise(F.col("size")) >= min_tokens)
    n, t = F.col("size"), F.col("tokens")
    depth = F.greatest(F.lit(3), F.least(F.lit(5), F.shiftright(n, 2)))
    rows = rows.withColumn("depth", depth)
    depth = F.col("depth")

    def leaf(path: int) -> Column:
        start = F.floor(path * (n - depth) / (PATHS - 1)).cast("int")
        return F.xxhash64(n, start, *(F.get(t, start + i) for i in range(3)), *(F.when(depth > i, F.get(t, start + i)) for i in (3, 4)))

    rows = rows.withColumn("leaves", F.array(*map(leaf, range(PATHS))))
    # Leaves of all lines, as a condition would have each of them computed from its own copy of the tokens.
    return rows.select("id", "text_hash", "place", "line", "check", F.when(F.col("own"), 0).otherwise(n).alias("n"), "leaves", F.when(~F.col("own") & (n < SHORT), F.col("words")).alias("words"))


def _leaves(lines: DataFrame, match: float) -> DataFrame:
    """text_hash, line, check, n, path (of a short line) and leaf of each path that a line takes."""
    columns = ["text_hash", *LINE, "n"]
    long = lines.filter(F.col("n") >= SHORT).select(*columns, F.lit(None).cast("int").alias("path"), F.explode("leaves").alias("leaf"))
    n, t, path = F.col("n"), F.split("words", " "), F.col("path")
    each = lines.filter(F.col("words").isNotNull() & (match * n <= n - 1)).select(*columns, t.alias("tokens"), F.explode(F.sequence(F.lit(0), n - 1)).alias("path"))
    lead = F.concat(F.slice("tokens", 1, path), F.slice("tokens", path + 2, F.lit(SHORT)))
    return long.unionByName(each.select(*columns, "path", F.xxhash64("n", "path", lead).alias("leaf")))


def _templates(lines: DataFrame, once: DataFrame, texts: DataFrame, scratch: Scratch, min_texts: int, match: float) -> DataFrame:
    """(line, check): the lines of templates that recur."""
    met = _leaves(lines, match).groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), F.min("line").alias("low"), F.max("line").alias("high"), F.bit_xor("line").alias("all"))
    # Of leaves that hold the same lines one is enough.
    met = met.filter((F.col("rows") >= min_texts) & (F.col("low") != F.col("high"))).groupBy("rows", "low", "high", "all").agg(F.min("leaf").alias("leaf"))
    met = scratch.write(met.select("leaf"))
    met_lines = scratch.join_small(_leaves(lines, match), met, ["leaf"], "left_semi").groupBy("leaf", *LINE).agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("path").alias("path"))
    met_lines = scratch.write(met_lines)

    # Their words, from one text that holds them.
    wanted = scratch.write(met_lines.groupBy(*LINE).agg(F.min("text_hash").alias("text_hash")))
    sources = scratch.join_small(texts, scratch.write(wanted.select("text_hash").distinct()), ["text_hash"], "left_semi")
    words = scratch.join_small(_hashed(_words(sources, "text")), wanted, ["text_hash", *LINE], "left_semi").groupBy(*LINE).agg(F.first("words").alias("words"))
    held = scratch.write(met_lines.drop("text_hash").join(words, LINE))

    long = held.filter(F.col("n") >= SHORT)
    votes = long.select("leaf", F.posexplode(F.split("words", " ")).alias("place", "token")).groupBy("leaf", "place", "token").agg(F.count(F.lit(1)).alias("n"))
    most = votes.groupBy("leaf", "place").agg(F.max(F.struct("n", "token"))["token"].alias("token"))
    template = scratch.write(most.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("template")))
    agreed = F.aggregate(F.zip_with(F.split("words", " "), "template", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, b: a + b)
    members = scratch.write(long.join(template, "leaf").filter(agreed >= match * F.col("n")).select("leaf", *LINE, "n", "words", "path").unionByName(held.filter(F.col("n") < SHORT).select("leaf", *LINE, "n", "words", "path")))

    supported = members.select("leaf", *LINE).join(once, LINE).select("leaf", "text_hash").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("texts"))
    supported = scratch.write(supported.filter(F.col("texts") >= min_texts))
    recurring = scratch.write(supported.join(_by_chance(lines, members, supported, scratch), "leaf", "left_anti").select("leaf"))
    return members.join(recurring, "leaf", "left_semi").select(*LINE)


def _by_chance(lines: DataFrame, members: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(leaf): short templates whose tokens meet by chance about as often as they do."""
    short = scratch.write(lines.filter("words IS NOT NULL").groupBy(*LINE).agg(F.first("n").alias("n"), F.first("words").alias("words")))
    lengths = short.groupBy("n").agg(F.count(F.lit(1)).alias("lines"))  # fewer than SHORT rows
    shares = short.select("n", F.explode(F.split("words", " ")).alias("token")).groupBy("n", "token").agg(F.count(F.lit(1)).alias("count"))
    shares = shares.join(F.broadcast(lengths), "n").select("n", "token", (F.col("count") / (F.col("n") * F.col("lines"))).alias("share"))
    one = members.filter(F.col("n") < SHORT).groupBy("leaf").agg(F.min(F.struct("words", "n", "path")).alias("x")).select("leaf", "x.*")
    words = F.split("words", " ")
    tokens = F.concat(F.slice(words, 1, F.col("path")), F.slice(words, F.col("path") + 2, F.lit(SHORT)))
    chance = one.select("leaf", "n", F.explode(tokens).alias("token")).join(shares, ["n", "token"]).groupBy("leaf", "n").agg(F.sum(F.log("share")).alias("log"))
    expected = chance.join(F.broadcast(lengths), "n").select("leaf", (F.exp("log") * F.col("lines")).alias("expected"))
    return texts.join(expected, "leaf").filter(F.col("texts") < LIFT * F.col("expected")).select("leaf")


def recurring_lines(lines: DataFrame, texts: DataFrame, scratch: Scratch, min_texts: int, match: float) -> DataFrame:
    """(line, check): the hashes of the lines to drop; ``texts`` has text_hash and text."""
    once = scratch.write(lines.select("text_hash", *LINE).distinct())
    counted = scratch.write(once.groupBy(*LINE).agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= min(2, min_texts)))
    exact = counted.filter(F.col("texts") >= min_texts).select(*LINE)
    template = _templates(lines, once, texts, scratch, min_texts, match)
    return scratch.write(exact.union(template).union(_long_lines(lines, counted, texts, scratch, min_texts)).distinct())


def _sequences(text: Column) -> Column:
    """Different hashes of each SHINGLE words in a row; of all words if there are fewer."""
    both = lambda x, y: F.zip_with(F.slice(x, 1, F.size(y)), y, lambda a, b: F.xxhash64(a, b))
    rest = lambda x, k: F.slice(x, k + 1, F.greatest(F.size(x) - k, F.lit(0)))
    bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  # x is evaluated once
    # Hashes of 2, 4 and then 5 words in a row.
    fives = lambda w: bound(both(w, rest(w, 1)), lambda two: bound(both(two, rest(two, 2)), lambda four: both(four, rest(w, 4))))
    of = lambda w: F.when(F.size(w) < SHINGLE, F.array(F.xxhash64(w))).otherwise(fives(w))
    words = F.split(_plain(F.lower(text)), " ")
    return F.array_distinct(bound(F.transform(words, lambda x: F.xxhash64(x)), of))


def _long_lines(lines: DataFrame, counted: DataFrame, texts: DataFrame, scratch: Scratch, min_texts: int) -> DataFrame:
    """(line, check): long lines in two or more texts, though not in ``min_texts``, that are no near copies."""
    rare = counted.filter((F.col("texts") >= 2) & (F.col("texts") < min_texts)).select(*LINE)
    each = lines.filter(F.col("n") >= LONG_TOKENS).select("text_hash", *LINE)
    held = scratch.write(each.join(rare, LINE, "left_semi").distinct().withColumnRenamed("text_hash", "a"))
    pairs = scratch.write(held.join(held.withColumnRenamed("a", "b"), LINE).filter("a < b"))  # fewer than min_texts texts a line
    ends = scratch.write(pairs.select("a", "b").distinct().select("a", "b", F.explode(F.array("a", "b")).alias("text_hash")))
    # Sequences are found once for each text and never stored.
    different = scratch.join_small(texts, scratch.write(ends.select("text_hash").distinct()), ["text_hash"], "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    both = different.select("text_hash", _sequences(F.col("text")).alias("of")).join(ends, "text_hash").groupBy("a", "b").agg(F.collect_list("of").alias("of"))
    common = F.size(F.array_intersect(F.col("of")[0], F.col("of")[1]))
    apart = both.filter(common < NEAR * (F.size(F.col("of")[0]) + F.size(F.col("of")[1]) - common)).select("a", "b")
    return pairs.join(scratch.write(apart), ["a", "b"], "left_semi").select(*LINE)


def drop_recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_texts: int = MIN_TEXTS, min_tokens: int = MIN_TOKENS, match: float = MATCH, counts: bool = False) -> DataFrame:
    """docs with recurring lines dropped from their texts; ``counts`` adds n_lines and n_dropped."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    lines = scratch.write(_lines(docs, doc_id, text, min_tokens))
    dropped = recurring_lines(lines, docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")), scratch, min_texts, match)
    hit = lines.select("id", "text_hash", "place", *LINE).join(dropped, LINE)
    places = scratch.write(hit.groupBy("id", "text_hash").agg(F.collect_set("place").alias("places")))
    scratch.keep_only(places)
    # Columns of docs travel in one struct, so that none of their names meets one of these.
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(doc_id).alias("own_id"), F.xxhash64(text).alias("own_hash"))
    joined = packed.join(places, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")), "left")
    n = F.when(F.col("doc")[text].isNull(), 0).otherwise(F.size(F.split(F.col("doc")[text], "\n")))
    # The lines are an argument, as an expression would split the text once for each of them.
    stay = lambda split: F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "places"), lambda i: F.get(split, i))
    kept = F.array_join(F.transform(F.array(F.split(F.col("doc")[text], "\n")), stay)[0], "\n")
    new = F.when(F.col("places").isNotNull(), kept).otherwise(F.col("doc")[text])
    extra = {"n_lines": n.cast("long"), "n_dropped": F.coalesce(F.size("places"), F.lit(0)).cast("long")} if counts else {}
    out = [(new if c == text else F.col("doc")[c]).alias(c) for c in docs.columns if c not in extra]
    return joined.select(*out, *(v.alias(k) for k, v in extra.items()))
