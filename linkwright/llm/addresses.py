"""Postal addresses written differently (problem 6).

A *form* is a set of street words, an *address* a house number with a form. Rewrites of words are
mined from addresses that agree elsewhere, applied, and mined again until no new one appears. Words
are counted, compared and rewritten in the table of forms; addresses hold only a form's hash, and
records meet their address only at the end. Which words are spelt alike is found once, in the
alphabet of all words.

A round mines four kinds of rewrites:

* *joined or split words* (at the beginning): sequences which are equal without blanks take the usual cutting;
* *abbreviations*: two words that stand in the same place of addresses with the same number and the
  same other words, significantly more often than by chance;
* *spellings*: a rare word that is one edit from, the consonants of, or the beginning of a far more
  frequent one, which, if several are possible, must also occur at the same number;
* *missing parts*: an address whose words are among those of exactly one other at its number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.store import Table, write

#: Words before the number of a flat or floor, and before a house number.
UNIT_WORDS = "apt apartment flat fl floor unit suite ste room rm".split()
NUMBER_WORDS = "no nr num number house".split()

#: How much more frequent a word must be than what is rewritten into it.
FREQUENT = 3
#: An abbreviation's least number of agreeing places, and the standard deviations above chance.
SUPPORT, SIGMAS = 3, 4.0
#: Least part of all rewrites of a word that its most frequent one must make up.
DOMINANCE = 0.5
#: An address form stands for itself if it has this part of the rows of the fuller form.
OWN_STREET = 0.25
MAX_ROUNDS = 50
#: Parts into which the rows of a location with very many are spread.
SALTS = 64

_GAP = r"[\s\p{Z}\p{P}#]*"
_NUMBER = r"\p{N}++(?:\p{L}(?!\p{L}))?+"
_UNIT = rf"(?:(?<!\p{{L}})(?:{'|'.join(UNIT_WORDS)})(?!\p{{L}})|#){_GAP}\p{{N}}(?:-?\p{{N}})*+(?:\p{{L}}(?!\p{{L}}))?+"
# in text without blanks, a flat's word may end a longer word
_JOINED_UNIT = rf"(?<=\p{{L}}{{4}})(?:{'|'.join(UNIT_WORDS)}){_NUMBER}(?=\P{{L}}*$)"
_SAID = rf"(?:(?<!\p{{L}})(?:{'|'.join(NUMBER_WORDS)})(?!\p{{L}}){_GAP})+(?=\p{{N}})"


def parse_addresses(records: DataFrame, house_col: str, street_col: str, number: str = "number", words: str = "words") -> DataFrame:
    """The rows with the house number and its letter, and the street's words joined by blanks; empty where missing.

    Flats and floors are left out. A number in the street's text counts if the house number's
    column has none. The steps are columns of their own, so that none is computed twice.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    text, fixed = F.col("__text"), F.col("__text")
    # scans take o, l and s for digits and m for rn
    for digit, letter in (("0", "o"), ("1", "l"), ("5", "s")):
        fixed = F.regexp_replace(fixed, rf"(?<=\p{{L}}){digit}(?=\p{{L}})", letter)
    left_out = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _UNIT, " "), _JOINED_UNIT, " "), _SAID, " ")
    own, s = F.regexp_extract(F.element_at("__parts", 1), _NUMBER, 0), F.element_at("__parts", 2)
    # both fields at once; nothing reaches over the mark between them
    out = records.withColumn("__text", F.lower(F.concat(blank(house_col), F.lit("\x01"), blank(street_col))))
    out = out.withColumn("__text", F.replace(F.regexp_replace(text, r"['’`´]|(?<=\p{N})[.](?=\p{N})|(?<=\p{L})[.-](?=\p{L})", ""), F.lit("rn"), F.lit("m")))
    out = out.withColumn("__text", F.when(text.rlike(r"\p{L}[015]\p{L}"), fixed).otherwise(text))
    # most texts have no number in the street and no word before the house number
    out = out.withColumn("__text", F.when(text.rlike(r"\x01.*[\p{N}#]|^[^\p{N}\x01]"), left_out).otherwise(text))
    out = out.withColumn("__parts", F.split(text, "\x01")).withColumn("__own", own)
    out = out.withColumn(number, F.regexp_replace(F.when(F.col("__own") != "", F.col("__own")).otherwise(F.regexp_extract(s, _NUMBER, 0)), r"^0+(?=\p{N})", ""))
    # a letter that belongs to a number goes with it
    out = out.withColumn(words, F.trim(F.regexp_replace(F.regexp_replace(s, _NUMBER, " "), r"\P{L}+", " ")))
    return out.drop("__text", "__parts", "__own")


def _bag(words: Column) -> Column:
    """Sorted words; a first word of up to two letters is marked, as it stands for something else than a last one."""
    parts = F.split(words, " ")
    short_first = (F.length(F.element_at(parts, 1)) <= 2) & (F.size(parts) > 1)
    marked = F.when(short_first, F.concat(F.array(F.concat(F.element_at(parts, 1), F.lit("^"))), F.slice(parts, 2, F.size(parts)))).otherwise(parts)
    return F.array_sort(F.array_distinct(marked))


def _cut_alike(forms: DataFrame) -> DataFrame:
    """``words, cut``: the most frequent cutting of the same letters, where it is another one."""
    order = Window.partitionBy("glued").orderBy(F.desc("n"), "words")
    best = F.first("words").over(order)
    return forms.withColumn("glued", F.replace("words", F.lit(" "), F.lit(""))).withColumn("cut", best).where("cut <> words").select("words", "cut")


def _words_of(forms: DataFrame) -> DataFrame:
    """``tok, n, partners`` of each word: the rows that have it, and how many words stand beside it."""
    n = forms.select(F.explode("bag").alias("tok"), "n").groupBy("tok").agg(F.sum("n").alias("n"))
    beside = forms.where("size(bag) > 1").select("bag", F.explode("bag").alias("tok")).select("tok", F.explode(F.array_except("bag", F.array("tok"))).alias("other")).distinct()
    return n.join(beside.groupBy("tok").agg(F.count(F.lit(1)).alias("partners")), "tok", "left").select("tok", "n", F.coalesce("partners", F.lit(0)).alias("partners"))


def _abbreviations(places: DataFrame, forms: DataFrame, counts: DataFrame) -> Table:
    """``tok, to``: words that replace each other in addresses with the same number and other words; ``places`` has ``number, fid``."""
    vocabulary = max(1, counts.count())
    specific = counts.where(F.col("partners") < max(20, 0.002 * vocabulary)).select(F.col("tok").alias("key"))
    slots = forms.where("size(bag) > 1").select("fid", F.explode("bag").alias("tok"), "bag").withColumn("others", F.array_except("bag", F.array("tok")))
    # one of the other words must be no common part of addresses
    slots = slots.select("fid", "tok", F.xxhash64(F.array_join("others", " ")).alias("rest"), F.explode("others").alias("key")).join(specific.hint("shuffle_hash"), "key", "left_semi").select("fid", "tok", "rest").distinct()
    seen = write(places.join(slots.hint("shuffle_hash"), "fid").select(F.xxhash64("number", "rest").alias("p"), "tok"), "places")
    tok = F.xxhash64("tok")
    several = seen.df.groupBy("p").agg(F.min(tok).alias("t0"), F.max(tok).alias("t1")).where("t0 <> t1").select("p")
    here = write(seen.df.join(several.hint("shuffle_hash"), "p", "left_semi"), "here")
    by_tok = write(seen.df.groupBy("tok").agg(F.count(F.lit(1)).alias("places")), "by_tok").df
    total = seen.df.agg(F.approx_count_distinct("p", 0.01)).first()[0]
    seen.drop()
    pairs = here.df.join(here.df.withColumnRenamed("tok", "to"), "p").where("tok <> to").groupBy("tok", "to").agg(F.count(F.lit(1)).alias("c"))
    n = counts.select("tok", "n")
    tested = pairs.where(F.col("c") >= 1).join(by_tok, "tok").join(by_tok.select(F.col("tok").alias("to"), F.col("places").alias("to_places")), "to").join(n, "tok").join(n.select(F.col("tok").alias("to"), F.col("n").alias("to_n")), "to")
    chance = F.col("to_places") / F.lit(float(max(1, total)))
    expected = F.col("places") * chance
    z = (F.col("c") - expected) / F.sqrt(expected * F.greatest(1 - chance, F.lit(0.0)) + 1e-9)
    whole = F.sum("c").over(Window.partitionBy("tok"))
    kept = tested.withColumn("part", F.col("c") / whole).withColumn("z", z).where((F.col("c") >= SUPPORT) & (F.col("z") >= SIGMAS) & (F.col("part") >= DOMINANCE) & (F.col("to_n") >= FREQUENT * F.col("n")))
    rules = kept.groupBy("tok").agg(F.max_by("to", "c").alias("to"))
    # a short word that is moved behind still means what it means in front, if it means nothing else there
    moved = rules.where(F.endswith("tok", F.lit("^"))).select(F.rtrim("tok", F.lit("^")).alias("tok"), "to")
    found = write(rules.unionByName(moved.join(rules, "tok", "left_anti").join(n, "tok", "left_semi")), "abbreviations")
    here.drop()
    return found


def _bones(c: str) -> Column:
    """A word's first letter and its consonants."""
    return F.concat(F.substring(c, 1, 1), F.translate(F.substring(F.col(c), F.lit(2), F.length(c)), "aeiou", ""))


def spelling_candidates(words: DataFrame) -> DataFrame:
    """``tok, to, kind``: words beside others which they may stand for, in both directions.

    ``words`` has ``tok``; words under four letters are left out. ``kind`` is 1 for the first letter
    and the consonants, 2 for one insertion, deletion, substitution or transposition in a word of
    five letters or more with vowels, 3 for a beginning of five letters or more. Words meet by equal
    keys: what is left without one letter, the consonants of one with the other, a beginning of one
    with the other.
    """
    long = words.where("length(tok) >= 4").select("tok")
    t = F.col("tok")
    deletes = F.transform(F.sequence(F.lit(0), F.length(t)), lambda i: F.when(i == 0, F.xxhash64(t)).otherwise(F.xxhash64(F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))))
    begins = F.when(F.length(t) > 5, F.transform(F.sequence(F.lit(5), F.length(t) - 1), lambda i: F.xxhash64(F.lit("p"), F.substring(t, F.lit(1), i)))).otherwise(F.array().cast("array<bigint>"))
    whole = F.array(F.xxhash64(F.lit("k"), t), F.xxhash64(F.lit("p"), t))
    left = long.select("tok", F.explode(F.array_distinct(F.concat(deletes, whole))).alias("key"))
    right = long.select(t.alias("to"), F.explode(F.array_distinct(F.concat(deletes, begins, F.array(F.xxhash64(F.lit("k"), _bones("tok")))))).alias("key"))
    pairs = left.join(right.hint("shuffle_hash"), "key").where("tok <> to")
    swapped = (F.length("tok") == F.length("to")) & (F.levenshtein("tok", "to") == 2) & (F.array_sort(F.split("tok", "")) == F.array_sort(F.split("to", "")))
    edited = ((F.levenshtein("tok", "to") == 1) | swapped) & (F.length("tok") >= 5) & (_bones("tok") != F.col("tok"))
    kinds = F.when(F.col("tok") == _bones("to"), 1).when(edited, 2).when((F.length("tok") >= 5) & F.startswith("to", "tok"), 3)
    return pairs.withColumn("kind", kinds).where("kind is not null").groupBy("tok", "to").agg(F.min("kind").alias("kind"))


def _spellings(places: DataFrame, forms: DataFrame, counts: DataFrame, alphabet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rewrites that hold everywhere, ``tok, to``; and those that hold at one number, ``number, tok, to``."""
    n = counts.select("tok", "n").hint("shuffle_hash")
    known = alphabet.join(n, "tok").join(counts.select(F.col("tok").alias("to"), F.col("n").alias("to_n")).hint("shuffle_hash"), "to")
    found = write(known.where(F.col("to_n") >= FREQUENT * F.col("n")).select("tok", "to", "to_n", "kind"), "spelt").df
    first = found.groupBy("tok").agg(F.min("kind").alias("kind"))
    best = found.join(first, ["tok", "kind"])
    sole = best.groupBy("tok", "kind").agg(F.count(F.lit(1)).alias("many")).where("many = 1 and kind <= 2").select("tok")
    everywhere = best.join(sole, "tok", "left_semi").select("tok", "to")
    unsure = write(found.join(sole, "tok", "left_anti"), "unsure").df
    # where the words in question stand, and which of what they may stand for stands there, too
    at = lambda words: places.join(forms.select("fid", F.explode("bag").alias("tok")).join(words, "tok", "left_semi").hint("shuffle_hash"), "fid").select("number", "tok")
    asked = write(at(unsure.select("tok").distinct()).distinct().join(unsure, "tok"), "asked").df
    there = at(unsure.select(F.col("to").alias("tok")).distinct()).withColumnRenamed("tok", "to")
    held = there.join(asked.select("number", "to").distinct().hint("shuffle_hash"), ["number", "to"], "left_semi").distinct()
    met = asked.join(held, ["number", "to"])
    first = met.groupBy("number", "tok").agg(F.min("kind").alias("kind"))
    ranked = met.join(first, ["number", "tok", "kind"]).groupBy("number", "tok").agg(F.max_by("to", "to_n").alias("to"), F.count(F.lit(1)).alias("many"))
    return everywhere, ranked.where("many = 1").select("number", "tok", "to")


def _fid(bag: str) -> Column:
    return F.xxhash64(F.array_join(bag, " "))


def _moved_forms(forms: DataFrame, general: DataFrame) -> DataFrame:
    """``fid, fid1, bag1``: the forms with words that are rewritten everywhere."""
    slots = forms.select("fid", "bag", F.explode("bag").alias("tok")).join(general, "tok").groupBy("fid").agg(F.map_from_entries(F.collect_list(F.struct("tok", "to"))).alias("new"))
    changed = forms.join(slots, "fid").select("fid", F.array_sort(F.array_distinct(F.transform("bag", lambda w: F.coalesce(F.element_at("new", w), w)))).alias("bag1"))
    return changed.select("fid", _fid("bag1").alias("fid1"), "bag1")


def _moved_places(places: DataFrame, forms: DataFrame, local: DataFrame) -> DataFrame:
    """``number, fid, fid1, bag1``: the addresses with words that are rewritten at their number."""
    slots = forms.select("fid", F.explode("bag").alias("tok")).join(local.select("tok").distinct(), "tok", "left_semi")
    new = places.join(slots.hint("shuffle_hash"), "fid").join(local.hint("shuffle_hash"), ["number", "tok"]).groupBy("number", "fid").agg(F.map_from_entries(F.collect_list(F.struct("tok", "to"))).alias("new"))
    changed = new.join(forms.select("fid", "bag"), "fid").select("number", "fid", F.array_sort(F.array_distinct(F.transform("bag", lambda w: F.coalesce(F.element_at("new", w), w)))).alias("bag1"))
    return changed.select("number", "fid", _fid("bag1").alias("fid1"), "bag1")


def _complete(here: DataFrame, forms: DataFrame) -> DataFrame:
    """``number, fid, fid1``: addresses whose words are among those of exactly one fuller one at their number.

    ``here`` has ``number, fid, here_n``, ``forms`` has ``fid, bag, n``.
    """
    slots = forms.select("fid", "bag", "n", F.explode("bag").alias("tok"))
    rare = slots.groupBy("tok").agg(F.sum("n").alias("tok_n"))
    # of a short form's words, the least frequent leads to the fuller ones
    lead = slots.join(rare.hint("shuffle_hash"), "tok").groupBy("fid").agg(F.min(F.struct("tok_n", "tok")).alias("l")).select("fid", F.col("l.tok").alias("tok"))
    part = forms.join(lead, "fid").select("tok", F.col("fid").alias("part_id"), F.col("bag").alias("part"), F.col("n").alias("part_n"))
    whole = slots.where("size(bag) > 1").select("tok", F.col("fid").alias("whole_id"), F.col("bag").alias("whole"), F.col("n").alias("whole_n"))
    inside = (F.col("part_n") < OWN_STREET * F.col("whole_n")) & (F.size("part") < F.size("whole")) & (F.size(F.array_except("part", "whole")) == 0)
    contained = part.join(whole, "tok").where(inside).select("part_id", "whole_id", F.size("whole").alias("k"), "whole_n")
    # an address has few forms that are parts of its own; of these, those that stand at its number
    full = here.select("number", F.col("fid").alias("whole_id"), "here_n").join(contained.hint("shuffle_hash"), "whole_id")
    met = write(full.join(here.select("number", F.col("fid").alias("part_id")).hint("shuffle_hash"), ["number", "part_id"]), "met").df
    best = met.groupBy("number", "part_id").agg(F.max(F.struct("k", "here_n", "whole_id", "whole_n")).alias("b"), F.count(F.lit(1)).alias("many"))
    # a candidate that the best one contains is no rival, unless it is a street of its own
    bag = lambda c, name: forms.select(F.col("fid").alias(c), F.col("bag").alias(name))
    others = met.join(best.where("many > 1").select("number", "part_id", F.col("b.whole_id").alias("best_id"), F.col("b.whole_n").alias("best_n")), ["number", "part_id"]).where("whole_id <> best_id")
    rivals = others.join(bag("whole_id", "whole"), "whole_id").join(bag("best_id", "best"), "best_id").where((F.size(F.array_except("whole", "best")) > 0) | (F.col("whole_n") >= OWN_STREET * F.col("best_n"))).select("number", "part_id").distinct()
    return best.join(rivals, ["number", "part_id"], "left_anti").select("number", F.col("part_id").alias("fid"), F.col("b.whole_id").alias("fid1"))


def _chained(rules: DataFrame) -> DataFrame:
    """Rules whose results are themselves rewritten go to the end at once, two steps at a time."""
    general = rules.where("number is null").select(F.col("tok").alias("to"), F.col("to").alias("then"))
    return rules.join(general, "to", "left").select("number", "tok", F.coalesce("then", "to").alias("to"))


def locate(records: DataFrame, house_col: str, street_col: str, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` and ``location`` of the records that have a location.

    Records without a number or without a street have none and are left out. Mining stops when a
    round brings no new rewrite. Extra columns are ignored, repeated rows stay; an empty table
    gives no rows.
    """
    if clash := {"number", "words", "location"} & set(keep):
        raise ValueError(f"these column names are taken: {sorted(clash)}")
    parsed = write(parse_addresses(records.select(*keep, F.col(house_col).alias("__house"), F.col(street_col).alias("__street")), "__house", "__street").drop("__house", "__street"), "parsed")
    rows = parsed.df.where("number <> '' and words <> ''")
    raw: Table = write(rows.groupBy("number", "words").agg(F.count(F.lit(1)).alias("n")), "raw")
    texts = raw.df.groupBy("words").agg(F.sum("n").alias("n"))
    cut = texts.join(_cut_alike(texts), "words", "left").select("words", _bag(F.coalesce("cut", "words")).alias("bag"))
    cut = write(cut.select("words", _fid("bag").alias("fid"), "bag"), "cut")
    aid = F.xxhash64("number", "words").alias("aid")
    now: Table = write(raw.df.join(cut.df.select("words", "fid").hint("shuffle_hash"), "words").select(aid, "number", "fid", "n"), "addresses")
    bags: Table = write(cut.df.groupBy("fid").agg(F.first("bag").alias("bag")), "bags")
    alphabet = write(spelling_candidates(bags.df.select(F.explode("bag").alias("tok")).distinct()), "alphabet")
    raw.drop()
    cut.drop()
    for _ in range(MAX_ROUNDS):
        here = write(now.df.groupBy("number", "fid").agg(F.sum("n").alias("here_n")), "here")
        forms = write(bags.df.join(here.df.groupBy("fid").agg(F.sum("here_n").alias("n")).hint("shuffle_hash"), "fid"), "forms")
        places = here.df.select("number", "fid")
        counts = write(_words_of(forms.df), "counts")
        abbreviations = _abbreviations(places, forms.df, counts.df)
        everywhere, at_number = _spellings(places, forms.df, counts.df, alphabet.df)
        nowhere = F.lit(None).cast("string").alias("number")
        spelled = everywhere.join(abbreviations.df, "tok", "left_anti")
        rules = write(abbreviations.df.select(nowhere, "tok", "to").unionByName(spelled.select(nowhere, "tok", "to")).unionByName(at_number.join(abbreviations.df, "tok", "left_anti")), "rules")
        final = write(_chained(_chained(rules.df)), "chained")
        general = write(_moved_forms(forms.df, final.df.where("number is null").select("tok", "to")), "general")
        local = write(_moved_places(places, forms.df, final.df.where("number is not null")), "local")
        # what holds at a number comes first; its words have no rule that holds everywhere
        here1 = here.df.join(local.df.select("number", "fid", "fid1").hint("shuffle_hash"), ["number", "fid"], "left").withColumn("mid", F.coalesce("fid1", "fid")).drop("fid1")
        both = write(_moved_forms(local.df.select(F.col("fid1").alias("fid"), F.col("bag1").alias("bag")).distinct(), final.df.where("number is null").select("tok", "to")), "both")
        onward = general.df.select(F.col("fid").alias("mid"), "fid1").unionByName(both.df.select(F.col("fid").alias("mid"), "fid1")).distinct()
        rewritten = write(here1.join(onward.hint("shuffle_hash"), "mid", "left").select("number", "fid", F.coalesce("fid1", "mid").alias("fid1"), "here_n"), "rewritten")
        made = bags.df.unionByName(general.df.select(F.col("fid1").alias("fid"), F.col("bag1").alias("bag"))).unionByName(local.df.select(F.col("fid1").alias("fid"), F.col("bag1").alias("bag"))).unionByName(both.df.select(F.col("fid1").alias("fid"), F.col("bag1").alias("bag")))
        now_here = rewritten.df.groupBy("number", F.col("fid1").alias("fid")).agg(F.sum("here_n").alias("here_n"))
        sized = write(now_here, "sized")
        streets = sized.df.groupBy("fid").agg(F.sum("here_n").alias("n"))
        new_bags = write(made.groupBy("fid").agg(F.first("bag").alias("bag")).join(streets.hint("shuffle_hash"), "fid"), "new_bags")
        filled = write(_complete(sized.df, new_bags.df), "filled")
        new = not (rules.df.isEmpty() and filled.df.isEmpty())
        if new:
            route = rewritten.df.join(filled.df.select("number", F.col("fid1").alias("fid2"), F.col("fid").alias("fid1")).hint("shuffle_hash"), ["number", "fid1"], "left").select("number", "fid", F.coalesce("fid2", "fid1").alias("to_id")).where("fid <> to_id")
            after = write(now.df.join(route.hint("shuffle_hash"), ["number", "fid"], "left").select("aid", "number", F.coalesce("to_id", "fid").alias("fid"), "n"), "addresses")
            kept_bags = write(new_bags.df.select("fid", "bag"), "bags")
        for x in (here, forms, counts, abbreviations, rules, final, general, local, both, rewritten, sized, new_bags, filled, *((now, bags) if new else ())):
            x.drop()
        if not new:
            break
        now, bags = after, kept_bags
    else:
        raise RuntimeError("the rewrites did not settle")
    places = now.df.join(bags.df.hint("shuffle_hash"), "fid").select("aid", F.concat_ws("|", F.col("number"), F.array_join("bag", " ")).alias("location"))
    return rows.select(*keep, aid).join(places.hint("shuffle_hash"), "aid").drop("aid")


def location_pairs(a: DataFrame, b: DataFrame, total_rows: int) -> DataFrame:
    """``idx_a, idx_b`` of records at one location with other bare addresses.

    ``a`` and ``b`` have ``idx, location, bare``. Locations that hold more than one part in 5000 of
    all rows, fewer than 5000, are known by broadcast; their ``a`` rows are spread over salts and
    their ``b`` rows repeated for each, so that no task gets such a location whole.
    """
    counts = a.select("location").unionByName(b.select("location")).groupBy("location").agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(counts.where(F.col("n") > max(1_000, total_rows // 5_000)).select("location", F.lit(True).alias("hot")))
    left = a.join(hot, "location", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("idx"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    right = b.join(hot, "location", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    x = left.select("location", "salt", F.col("idx").alias("idx_a"), F.col("bare").alias("bare_a"))
    y = right.select("location", "salt", F.col("idx").alias("idx_b"), F.col("bare").alias("bare_b"))
    return x.join(y, ["location", "salt"]).where("bare_a <> bare_b").select("idx_a", "idx_b")
