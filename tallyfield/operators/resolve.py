"""Entity resolution: names asked for, matched to the names that entities go by."""

from __future__ import annotations

from itertools import combinations
from math import comb, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_name
from ..sources.shared import checkpointed

#: The fields that hold an entity's names; an equal name in the first one comes before one in another.
FIELDS = ("location", "display_name", "abbr", "short_name", "name")


def _edits(least: float, longer: Column) -> Column:
    """The edits that a similarity of ``least`` allows where the longer name has so many characters."""
    return F.floor((1 - least) * longer + 1e-9)


#: Names are found by their forms up to the length at which a name has more of them than this; longer ones by grams.
FORMS = 500


def _formed(least: float) -> int:
    """The length of the longest names that have few forms."""
    few = lambda n: comb(n, floor((1 - least) * n + 1e-9)) <= FORMS
    return next(n for n in range(1, 65) if n == 64 or not few(n + 1))


def _by_forms(asked: DataFrame, known: DataFrame, least: float, longest: int) -> DataFrame:
    """asked, name, longer: pairs that have a form in common, where the longer name has at most ``longest`` characters; rows may repeat. Each edit changes at most one character of
    the longer name, so with e edits the two have longer - e characters in common, in their order: each name is spelled out in its forms of so many
    characters, for each length that the longer one may have, and equal forms meet by a hash. A form that few names have brings few pairs, whatever grams they share."""
    common = lambda n: n - floor((1 - least) * n + 1e-9)
    longer = lambda n: [m for m in range(n, longest + 1) if common(m) <= n]
    # a key of its own where the name asked for is the shorter one
    questions = {n: [(m if m == n else -m, common(m)) for m in longer(n)] for n in range(1, longest + 1)}
    answers = {n: [(m, common(m)) for m in longer(n)] + [(-n, common(n))] for n in range(1, longest + 1)}
    odd = np.uint64(0x9E3779B97F4A7C15)

    def forms(names: DataFrame, lengths: dict, into: str) -> DataFrame:
        def spell(batches):
            for batch in batches:
                sizes, texts = batch.column("n").to_numpy(), batch.column("s").to_pylist()
                for n in np.unique(sizes).tolist():
                    letters = np.array([[ord(c) for c in texts[i]] for i in np.flatnonzero(sizes == n)], dtype=np.uint64)
                    mine = pa.array([texts[i] for i in np.flatnonzero(sizes == n)])
                    for kind, k in lengths[n]:
                        places = np.array(list(combinations(range(n), k)))
                        step = max(1, (1 << 18) // len(places))
                        for start in range(0, len(letters), step):
                            part = letters[start : start + step]
                            keys = np.full((len(part), len(places)), kind % (1 << 64), dtype=np.uint64)
                            for j in range(k):
                                keys = (keys + part[:, places[:, j]] + np.uint64(1)) * odd
                                keys ^= keys >> np.uint64(31)
                            keys.sort(axis=1)
                            row, at = np.nonzero(np.diff(keys, axis=1, prepend=~keys[:, :1]))  # a form that a name has twice counts once
                            yield pa.RecordBatch.from_arrays([mine.take(pa.array(row + start)), pa.array(np.full(len(row), n, dtype=np.int32)), pa.array(keys[row, at].view(np.int64))], names=[into, f"n_{into}", "key"])

        parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes that become many
        return names.where(F.col("n") <= longest).repartition(parts, "s").mapInArrow(spell, f"{into} string, n_{into} int, key long")

    met = forms(asked, questions, "asked").hint("merge").join(forms(known, answers, "name"), "key").where("asked <> name")
    return met.select("asked", "name", F.greatest("n_asked", "n_name").alias("longer"))


def _by_grams(asked: DataFrame, known: DataFrame, least: float, beyond: int) -> DataFrame:
    """asked, name, longer: pairs that share enough grams, where the longer name has more than ``beyond`` characters. One edit changes at most q grams of q characters, so two names share at least
    longer - q + 1 - q edits of them, repeated grams counted apart; grams are pairs of characters where that is always one or more (above 2/3),
    else single ones. All names' grams are in one order, rare ones first, and of each name only so many are indexed that two names which share
    enough have one of these in common. A posting list holds names of one length; a name asks the lists of lengths that it can match,
    and a shared gram counts only where enough grams come after it in both names.

    The frequencies are of grams over 40 characters, 1,600 rows at most, whatever the names; so they are broadcast."""
    q = 2 if least > 2 / 3 else 1

    def needed(longer: Column) -> Column:
        return longer - q + 1 - q * _edits(least, longer)

    def ordered(names: DataFrame) -> DataFrame:
        """Names with their length and grams; the same gram again is another one, by number."""
        s = names.where(F.floor(F.col("n") / least + 1e-9) > beyond)
        return s.where(F.col("n") >= q).withColumn("grams", F.transform(F.sequence(F.lit(1), F.col("n") - q + 1), lambda i: F.substring("s", i, F.lit(q))))

    both = {"asked": ordered(asked), "name": ordered(known)}
    grams = both["asked"].select("grams").unionByName(both["name"].select("grams")).select(F.explode("grams").alias("gram"))
    often = F.broadcast(grams.groupBy("gram").agg(F.count("*").alias("often")))

    def indexed(names: DataFrame) -> DataFrame:
        """s, n, number of grams, and the indexed grams with their places."""
        again = lambda i: F.size(F.filter(F.slice("grams", 1, i), lambda x: x == F.element_at("grams", i)))
        numbered = F.transform(F.sequence(F.lit(1), F.size("grams")), lambda i: F.struct(F.element_at("grams", i).alias("gram"), again(i).alias("again")))
        rows = names.select("s", "n", F.inline(numbered)).join(often, "gram")
        lists = rows.groupBy("s", "n").agg(F.array_sort(F.collect_list(F.struct((-F.col("again")).alias("a"), "often", "gram"))).alias("tokens"))
        longest = F.floor(F.col("n") / least + 1e-9).cast("int")
        fewest = F.array_min(F.transform(F.sequence(F.col("n"), longest), needed))
        kept = F.slice("tokens", 1, F.greatest(F.lit(1), F.size("tokens") - fewest + 1).cast("int"))
        return lists.select("s", "n", F.size("tokens").alias("size"), F.posexplode(kept).alias("place", "token"))

    # a name's length is at least the other's times ``least``
    shortest, longest = F.ceil(F.col("n") * least - 1e-9).cast("int"), F.floor(F.col("n") / least + 1e-9).cast("int")
    questions = indexed(both["asked"]).select(F.col("s").alias("asked"), F.col("n").alias("na"), F.col("size").alias("ga"), F.col("place").alias("pa"), "token", F.explode(F.sequence(shortest, longest)).alias("n")).where(F.greatest("na", "n") > beyond)
    lists = indexed(both["name"]).select(F.col("s").alias("name"), "n", F.col("size").alias("gn"), F.col("place").alias("pn"), "token")
    met = questions.join(lists, ["token", "n"]).where("asked <> name").where(F.least(F.col("ga") - F.col("pa"), F.col("gn") - F.col("pn")) >= needed(F.greatest("na", "n")))
    return met.select("asked", "name", F.greatest("na", "n").alias("longer")).distinct()


def similar_names(asked: DataFrame, known: DataFrame, least: float = 0.75) -> DataFrame:
    """asked, name, score: all pairs of different normal names whose Levenshtein ratio, 1 - edits / longer length, is ``least`` or more.

    Pairs of names with few forms are found by these, so the work grows with the names and the pairs that nearly match; an inverted index of grams finds the others, which
    are between long names. What is found is compared. Null and empty names match nothing.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    return _similar(_distinct(asked, "asked"), _distinct(known, "name"), least)


def _distinct(names: DataFrame, column: str) -> DataFrame:
    """s, n: the different normal names and their lengths, written once, as several searches read them."""
    return checkpointed(names.select(normal_name(F.col(column)).alias("s")).where("s <> ''").distinct().withColumn("n", F.length("s")))


def _similar(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    limit = _formed(least)
    pairs = _by_forms(asked, known, least, limit).unionByName(_by_grams(asked, known, least, limit))
    score = (1 - F.levenshtein("asked", "name") / F.col("longer")).alias("score")
    return pairs.select("asked", "name", score).where(F.col("score") >= least - 1e-9).distinct()


def nearest_names(asked: DataFrame, known: DataFrame, least: float = 0.75) -> DataFrame:
    """asked, name, score: of each name asked for the most similar one of ``least`` or more, of equally similar ones the first in the alphabet. Nearer names are
    searched for first, and then for the names that have none of these all others, so that a name with a near one doesn't meet all that are further off."""
    first = lambda pairs: pairs.groupBy("asked").agg(F.min(F.struct((-F.round("score", 9)).alias("far"), "name", "score")).alias("m")).select("asked", "m.name", "m.score")
    asked, known = _distinct(asked, "asked"), _distinct(known, "name")
    near = checkpointed(first(_similar(asked, known, 1 - (1 - least) * 2 / 3)))
    rest = checkpointed(asked.join(near.select(F.col("asked").alias("s")), "s", "left_anti"))
    return near.unionByName(first(_similar(rest, known, least)))


def resolve(asked: DataFrame, entities: DataFrame, popularity: DataFrame, aliases: DataFrame | None = None, least: float = 0.75, id: str = "team_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """asked, entity, how, name, score: the entity that each different text of ``asked`` means.

    Names are compared in normal form, after ``aliases`` (alias, name) have replaced a text that is an alias as a whole. An entity that has the
    name in the first of ``fields`` comes before one that has it in another (``how``: exact); then the greater number in ``popularity`` (id, n)
    counts, then the smaller id. Where no entity has the name, the most similar name of ``least`` or more is taken, of equally similar ones the
    first in the alphabet, and of the entities with that name the most popular (fuzzy). Else, and for null and empty texts, entity, name and score
    are null (none). Repeated entities and aliases don't matter: of an alias with several names the first in the alphabet counts.
    """
    texts = asked.select("asked").distinct().withColumn("q", normal_name(F.col("asked")))
    if aliases is not None:
        known = aliases.select(normal_name(F.col("alias")).alias("q"), normal_name(F.col("name")).alias("to")).groupBy("q").agg(F.min("to").alias("to"))
        texts = texts.join(known, "q", "left").withColumn("q", F.coalesce("to", "q")).drop("to")
    texts = checkpointed(texts)
    each = [F.struct(normal_name(F.col(f)).alias("name"), F.lit(int(i > 0)).alias("rank")) for i, f in enumerate(fields)]
    names = entities.select(F.col(id).alias("entity"), F.inline(F.array(*each))).where("name <> ''").groupBy("entity", "name").agg(F.min("rank").alias("rank"))
    count = popularity.groupBy(F.col(id).alias("entity")).agg(F.sum("n").alias("n"))
    names = names.join(count, "entity", "left").select("name", F.struct("rank", (-F.coalesce("n", F.lit(0))).alias("less"), "entity").alias("first"))
    best = checkpointed(names.groupBy("name").agg(F.min("first").alias("first"), F.min(F.struct("first.less", "first.entity")).alias("popular")))
    q = texts.select("q").where("q <> ''").distinct()
    exact = q.join(best, q["q"] == best["name"]).select("q", F.col("first.entity").alias("entity"), F.lit("exact").alias("how"), "name", F.lit(1.0).alias("score"))
    nearest = nearest_names(q.join(best.select(F.col("name").alias("q")), "q", "left_anti").withColumnRenamed("q", "asked"), best.select("name"), least)
    fuzzy = nearest.withColumnRenamed("asked", "q").join(best, "name").select("q", F.col("popular.entity").alias("entity"), F.lit("fuzzy").alias("how"), "name", "score")
    return texts.join(exact.unionByName(fuzzy), "q", "left").select("asked", "entity", F.coalesce("how", F.lit("none")).alias("how"), "name", "score")
