"""Spelling variants: pairs of words that differ by one edit, by merging the light subtrees of a trie.

The words form a trie; each node's heavy child is the one with the most words below it (ties: the larger
character). Two words part at one node p. Below it, a word w = p c r through a light child c is merged
into the rest of the node's subtree in every way that one edit allows:

* c replaced by the heavy character h:  p h r      (a replaced character, the partner is heavy)
* c skipped:                            p r        (a character too many in w)
* the heavy character skipped:          p h c r    (a character too few in w)
* c replaced by any light character:    equal (p, r) among the light children's words

and a word that ends at p is merged into its heavy subtree as p h. Where a merged word falls on the
end of another word, the two are one edit apart. At least one of two words that part goes through a
light child (or ends there), so every pair is found, at the node where it parts and nowhere else. Only light
subtrees move: a word is in at most log2(words) of them, so the merged rows are words * log(words) however
the words are distributed.

Everything is DataFrame operations. Subtree sizes are partial counts, so a node with all words below
it is one row a task; the joins on nodes and words have one row a key on one side, so Spark splits a hot
key's other side. Words that are equal but for one fixed position are as many as there are
characters, which bounds the only rows that meet in a group.

Defined results: null and empty texts have no words; a null id counts as an empty one in what
perturbs a run; repeated rows count as often as they are there; equal counts are ordered by code points;
empty tables give empty results; other columns are never read. A text's runs are one array in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealgraph.llm.common import forget, stored, table

#: Characters of a run.
LETTERS = "[A-Za-zÀ-ÿ]"
MIN_LENGTH = 7
MIN_COUNT = 2
#: A run whose check sum this divides loses a character.
EVERY = 31
#: A form is at least so many times as frequent as its word.
RATIO = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(c: Column) -> Column:
    return F.when(F.lower(c) == c, c).otherwise(F.translate(c, _UPPER, _LOWER))


def _from(c: Column, at: Column) -> Column:
    """What follows the first `at` characters."""
    return F.substring(c, at + 1, F.char_length(c))


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: str = LETTERS, min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, every: int | None = EVERY) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z in lower case, with at least min_length
    characters and min_count occurrences. With `every`, a run loses the character h % length if
    `every` divides h, the check sum of '<doc_id>:<run>'."""
    runs = docs.select(F.col(doc_id).cast("string").alias("i"),
                       F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"{letters}{{{min_length},}}"), F.lit(0))).alias("r"))
    runs = runs.select("i", _ascii_lower(F.col("r")).alias("word"))
    if every:
        h = F.crc32(F.concat(F.coalesce("i", F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = (F.col("h") % F.char_length("word")).cast("int")
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, F.concat(F.substring("word", F.lit(1), at), _from(F.col("word"), at + 1))).otherwise(F.col("word")).alias("word"))
    return runs.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def light_nodes(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the trie of words: (node, heavy) of each light child, heavy being its heaviest sibling's
    character, and (word, heavy) of each inner node, heavy being its heavy child's."""
    prefixes = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda d: F.substring("word", F.lit(1), d))).alias("node"))
    sizes = prefixes.groupBy("node").agg(F.count("*").alias("size")).select(
        F.substring("node", F.lit(1), F.char_length("node") - 1).alias("parent"), F.substring("node", -1, 1).alias("c"), "size")
    # a node has as many children as there are characters
    heaviest = F.max(F.struct("size", "c")).over(Window.partitionBy("parent"))["c"]
    children = stored(sizes.select("parent", "c", heaviest.alias("heavy")))
    return (children.where("c <> heavy").select(F.concat("parent", "c").alias("node"), "heavy"),
            children.where("c = heavy").select(F.col("parent").alias("word"), "heavy"))


def one_edit_links(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of words (word, n) that differ by one inserted, deleted or
    replaced character, once. Words must be distinct and not null."""
    light, inner = light_nodes(words)
    # each word at every node of its path: d is the position of the node's character
    path = words.select("word", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda d: F.substring("word", F.lit(1), d))).alias("d", "node"))
    moved = stored(path.join(light, "node").select("word", "n", "d", "heavy"))
    w, d = F.col("word"), F.col("d")
    p, c, r = F.substring(w, F.lit(1), d), F.substring(w, d + 1, F.lit(1)), _from(w, d + 1)
    merged = moved.select("word", "n", F.explode(F.array(
        F.concat(p, "heavy", r),
        F.when(~F.startswith(r, c), F.concat(p, r)),  # else the two part further down
        F.concat(p, "heavy", c, r))).alias("end")).where("end is not null")
    ends = words.join(inner, "word").select("word", "n", F.concat("word", "heavy").alias("end"))
    met = merged.unionByName(ends).join(words.select(F.col("word").alias("end"), F.col("n").alias("end_n")), "end")
    both = met.select(F.explode(F.array(F.struct("word", F.col("end").alias("near"), F.col("end_n").alias("near_n")),
                                        F.struct(F.col("end").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("l")).select("l.*")
    # light subtrees of one node among themselves, by the node and what follows the replaced character
    among = moved.select("word", "n", "d", p.alias("p"), r.alias("r"))
    other = among.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "d", "p", "r")
    return both.unionByName(among.join(other, ["d", "p", "r"]).where("word <> near").select("word", "near", "near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms (word, form) that starts at a word ends. Each round doubles
    the steps taken; a chain has at most log10(n) of them, as counts grow tenfold with each."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(at.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        forget(at)
        at = after.drop("moved")
        if after.where("moved").isEmpty():
            return at


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n): the number of words one edit away, the most
    frequent of them (ties: the smallest) if it is ratio times as frequent, and the end of the chain of forms."""
    words = stored(words.select("word", "n"))
    near = one_edit_links(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    best_n = -F.col("best.m")
    out = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(best_n >= ratio * F.col("n"), F.col("best.near")).alias("form"),
        F.when(best_n >= ratio * F.col("n"), best_n).alias("form_n")))
    found = out.join(roots(out.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents")))


#: Independent of the trie: pairs meet at words with one character left out.
OP13_SQL = r"""
with recursive sums as (
  select list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) t from range(256) r(i)),
runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') r from documents),
counted as (select r, hex(encode(coalesce(doc_id::varchar, '') || ':' || r)) x, count(*) k from runs where length(r) >= 7 group by 1, 2),
summed as (
  select r, k, xor(list_reduce([4294967295] || list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::bigint),
                               lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) h
  from counted, sums),
words as (
  select word, sum(k)::bigint n
  from (select case when h % 31 = 0 then left(r, (h % length(r))::int) || substr(r, (h % length(r))::int + 2) else r end word, k from summed)
  where length(word) >= 7 group by 1 having sum(k) >= 2),
less as (select distinct word, n, pos, left(word, pos::int) || substr(word, pos::int + 2) rest from words, unnest(range(0, length(word))) u(pos)),
pairs as (
  select a.word, b.word near, b.n near_n from less a join less b on a.rest = b.rest and a.pos = b.pos and a.word <> b.word
  union select a.word, b.word, b.n from less a join words b on a.rest = b.word
  union select b.word, a.word, a.n from less a join words b on a.rest = b.word),
near as (select word, count(*) n_near, max(near_n) best from pairs group by 1),
best as (select word, min(near) form, near_n form_n from pairs join near using (word) where near_n = best group by word, near_n),
formed as (
  select word, case when form_n >= 10 * n then form end form, n, coalesce(n_near, 0) n_near, case when form_n >= 10 * n then form_n end form_n
  from words left join near using (word) left join best using (word)),
chain as (
  select word, coalesce(form, word) root from formed
  union select c.word, f.form from chain c join formed f on f.word = c.root where f.form is not null)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n
from formed f join chain c on c.word = f.word join formed e on e.word = c.root
where e.form is null
"""
