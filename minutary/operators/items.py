"""Actions, decisions and questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from minutary.functions import cues, text as tx
from minutary.operators import joins, ordering
from minutary.operators.terms import top_per
from minutary.session import settle

_PLACE = ["meeting_id", "turn", "pos"]
CLOSES_AT = 0.5
# Lists of more words than this do not travel with each word of a wording.
LISTED_WORDS = 256
# Scores looked for one after the other, before the least that counts.
LEVELS = (1.0, 0.5, 0.25)

LANGUAGE = "en"


def _by_rarest_word(sentences: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Sentences, which have a `lang`, with `kind` for each kind of phrase found in them.

    A phrase is looked for where the rarest of its words is, rarest in the sentences. Only ids and words are shuffled
    for that; the text comes in for the sentences that have such a word. Spark broadcasts the phrases if they are few.
    """
    phrases = settle(cues.phrases(lexicon))
    wanted = phrases.select("lang", F.explode("words").alias("word")).distinct()
    spoken = sentences.select(*_PLACE, "lang", F.explode(F.array_distinct(tx.word_list(F.col("sentence")))).alias("word"))
    known = spoken.join(wanted, ["lang", "word"], "left_semi")
    counts = known.groupBy("lang", "word").count()
    each = phrases.select("kind", "lang", "phrase", F.explode("words").alias("word")).join(counts, ["lang", "word"], "left")
    # A word that no sentence has is the rarest, and finds nothing.
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "word"))["word"]
    keyed = each.groupBy("kind", "lang", "phrase").agg(rarest.alias("word"))
    met = known.join(keyed, ["lang", "word"]).select(*_PLACE, "kind", "lang", "phrase")
    checked = ordering.join_on(met, sentences, [*_PLACE, "lang"]).filter(cues.holds_phrase(F.col("sentence"), F.col("phrase")))
    return checked.drop("phrase").distinct()


def cue_items(sentences: DataFrame, lexicon: list[cues.Cue] | DataFrame | None = None, lang: str = LANGUAGE) -> DataFrame:
    """One row per sentence and kind of cue found in it, with its `speaker` if there is one.

    Only cues of the sentence's language count: that of its column `lang`, or else `lang` for all.

    Listed cues of a kind form one pattern tested in the row, so sentences are not multiplied by cues and nothing is
    shuffled. A table of cues (kind, lang, pattern), of any size, holds phrases (`cues.phrases`) and is joined by words;
    sentences of the same place and text then count once.
    """
    own = F.col("lang") if "lang" in sentences.columns else F.lit(lang)
    kept = [name for name in ("speaker",) if name in sentences.columns]
    if isinstance(lexicon, DataFrame):
        found = _by_rarest_word(sentences.select(*_PLACE, "sentence", *kept, own.alias("lang")), lexicon)
    else:
        kinds = cues.kinds_of(F.col("sentence"), cues.CUES if lexicon is None else lexicon, own)
        found = sentences.select(*_PLACE, "sentence", *kept, F.explode(kinds).alias("kind"))
    item_id = F.sha2(F.concat_ws("|", "meeting_id", "turn", "pos", "kind"), 256)
    return found.select(item_id.alias("item_id"), "meeting_id", "turn", "pos", "kind", "sentence", *kept)


def item_fields(items: DataFrame) -> DataFrame:
    """Fill `owner` and `due` from the sentence; what cannot be read is null. "I" is the
    `speaker`, if the items have one."""
    sentence = F.col("sentence")
    speaker = F.col("speaker") if "speaker" in items.columns else F.lit(None).cast("string")
    return items.withColumn("owner", cues.owner_of(sentence, speaker)).withColumn("due", cues.due_of(sentence))


def open_items(items: DataFrame, done: DataFrame, opened: str = "opened_at", closed: str = "done_at") -> DataFrame:
    """Items without a done record of the same `item_id` at or after their opening.

    Only the latest done record matters, so many records of one item become one row
    before the join.
    """
    latest = done.groupBy("item_id").agg(F.max(closed).alias("_closed"))
    joined = items.join(latest, "item_id", "left")
    return joined.filter(F.col("_closed").isNull() | (F.col("_closed") < F.col(opened))).drop("_closed")


def _word_sets(items: DataFrame) -> DataFrame:
    """Items with the hashes of their words and an id of the set of these."""
    words = F.array_sort(F.array_distinct(F.transform(tx.word_list(F.col("sentence")), lambda word: F.xxhash64(word))))
    return items.withColumn("_words", words).withColumn("_set", F.xxhash64("_words"))


def _wordings(actions: DataFrame, reports: DataFrame) -> DataFrame:
    """(_set, _words, _first, _told): the different wordings, where an action has it first (null: nowhere) and whether a report has it."""
    asked = actions.select("_set", "_words", F.col("opened_at").alias("_first"), F.lit(False).alias("_told"))
    told = reports.select("_set", "_words", F.lit(True).alias("_told"))
    both = asked.unionByName(told, allowMissingColumns=True)
    return both.groupBy("_set", "_words").agg(F.min("_first").alias("_first"), F.max("_told").alias("_told"))


def _weights(wordings: DataFrame) -> DataFrame:
    """(word, count, weight, w) for each word that an action has: ln(wordings / wordings with the word), `w` in millionths."""
    total = wordings.count()
    each = wordings.select("_first", F.explode("_words").alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("count"), F.count("_first").alias("_asked")).filter("_asked > 0")
    weight = F.ln(F.lit(float(total + 1)) / F.col("count"))
    return counts.select("word", "count", weight.alias("weight"), F.round(weight * 1_000_000).cast("int").alias("w"))


def _under_each_word(wordings: DataFrame, weights: DataFrame) -> DataFrame:
    """Wordings under each of their words that an action has, with `_left`, the weight of this word and of those that are not
    rarer, and `_whole`, that of all. `_rest` and `_rest_w` list what is left, or are null if it is more than `LISTED_WORDS` words.
    """
    weighed = wordings.withColumn("word", F.explode("_words")).drop("_words").join(weights, "word")
    one = Window.partitionBy("_set")
    common_first = one.orderBy(F.desc("count"), F.desc("word"))
    so_far = common_first.rowsBetween(Window.unboundedPreceding, 0)
    few = F.col("_place") <= LISTED_WORDS
    found = weighed.withColumn("_place", F.row_number().over(common_first)).withColumns({
        "_left": F.sum("w").over(so_far), "_whole": F.sum("weight").over(one),
        "_listed": F.collect_list(F.when(few, F.struct("word", "w"))).over(so_far),
    })
    lists = {"_rest": F.when(few, F.col("_listed.word")), "_rest_w": F.when(few, F.col("_listed.w"))}
    return found.withColumns(lists).drop("count", "weight", "_place", "_listed")


def _share(millionths: Column) -> Column:
    """The share of an action's weight that some of its words have."""
    return tx.rounded(millionths / 1_000_000 / F.col("_whole"), 4)


def _best_wordings(keys: DataFrame, told: DataFrame, reports: DataFrame, least: float, long: bool) -> DataFrame:
    """(action_set, report, told_at, score): the earlier wordings with the highest score for a report, if it is `least` or more.

    Wordings of actions (`keys`) and reports (`told`) meet under each word that can be the rarest they share if they reach `least`,
    which takes enough weight left on both sides. The score is worked out from what is left, which travels with the words, so only
    pairs that reach `least` leave the join. Under its other words a pair scores no more. If there are `long` wordings, whose
    words are not all listed, their pairs are joined by words instead.
    """
    asked = keys.filter(_share(F.col("_left")) >= least).withColumnRenamed("_set", "action_set")
    there = told.withColumnsRenamed({"_set": "report_set", "_left": "_told_left", "_rest": "_told_rest"})
    met = asked.join(there, "word").filter(_share(F.col("_told_left")) >= least)
    pair = ["action_set", "report_set", "_first", "_whole"]
    both = F.zip_with("_rest", "_rest_w", lambda word, w: F.when(F.array_contains("_told_rest", word), w).otherwise(0))
    shared = F.aggregate(both, F.lit(0).cast("long"), lambda so_far, w: so_far + w)
    summed = met.filter("_rest IS NOT NULL AND _told_rest IS NOT NULL").select(*pair, shared.alias("_shared"))
    if long:
        cut = met.filter("_rest IS NULL OR _told_rest IS NULL").select(*pair).distinct()
        each = cut.join(keys.select(F.col("_set").alias("action_set"), "word", "w"), "action_set")
        common = each.join(there.select("report_set", "word"), ["report_set", "word"])
        summed = summed.unionByName(common.groupBy(*pair).agg(F.sum("w").alias("_shared")))
    pairs = summed.withColumn("score", _share(F.col("_shared"))).filter(F.col("score") >= least).drop("_whole", "_shared")
    asking = reports.select(F.col("item_id").alias("report"), F.col("_set").alias("report_set"), "told_at").join(pairs, "report_set")
    by_score = Window.partitionBy("report").orderBy(F.desc("score"))
    ranked = asking.filter("_first < told_at").withColumn("_rank", F.rank().over(by_score))
    return ranked.filter("_rank = 1").select("action_set", "report", "told_at", "score").distinct()


def closed_items(items: DataFrame, opening: str = "action", closing: str = "done", least: float = CLOSES_AT) -> DataFrame:
    """Items of kind `opening`, with `closed_by`, the id of the first report (an item of kind `closing`) that closes it in this or a
    later meeting, or null while it is open. Meetings stand in order of their ids.

    A report closes one item: of the earlier ones whose wording it shares to at least `least`, the one with the highest
    score, of these the latest, and then the smallest id. Only wordings are matched, so a wording
    used very often is one, and of its items the latest before the report is found in order, without pairs.
    The score is the share of the weight of an action's words, ln(wordings / wordings with the word), that the report has too.
    No pair that reaches `least`, which is above 0, is left out. High scores are looked for first: they need
    fewer and rarer words, and a report that has found one is not looked at again.
    Items without a meeting or turn stay open and close nothing; sentences without words match nothing.
    """
    placed = _word_sets(items.filter("meeting_id IS NOT NULL AND turn IS NOT NULL AND pos IS NOT NULL"))
    at = lambda late: F.struct(*_PLACE, F.lit(late).alias("late"))
    actions = settle(placed.filter(F.col("kind") == opening).select("item_id", "_set", "_words", at(1).alias("opened_at")))
    reports = settle(placed.filter(F.col("kind") == closing).select("item_id", "_set", "_words", at(0).alias("told_at")))
    wordings = settle(_wordings(actions, reports))
    weights = settle(_weights(wordings))
    long = not wordings.filter(F.size("_words") > LISTED_WORDS).isEmpty()
    keys = settle(_under_each_word(wordings.filter("_first IS NOT NULL").drop("_told"), weights))
    told = settle(_under_each_word(wordings.filter("_told").select("_set", "_words"), weights).select("_set", "word", "_left", "_rest"))
    waiting, found = reports, []
    for level in [*(level for level in LEVELS if level > least), least]:
        if found:
            waiting = settle(waiting.join(found[-1].select(F.col("report").alias("item_id")), "item_id", "left_anti"))
            told = settle(told.join(waiting.select("_set").distinct(), "_set", "left_semi"))
        found.append(settle(_best_wordings(keys, told, waiting, level, long)))
    asking = reduce(DataFrame.unionByName, found)
    # One mark per wording and place: of several the smallest id.
    marks = actions.groupBy(F.col("_set").alias("action_set"), "opened_at").agg(F.min("item_id").alias("closes"))
    latest = joins.latest_before(
        asking, marks, at="told_at", row_id="report",
        mark_at="opened_at", mark_id="closes", values=["closes", "opened_at"], keys=["action_set"],
    ).filter("closes IS NOT NULL")
    order = [F.desc("score"), F.desc("opened_at"), F.col("closes")]
    best = top_per(latest, ["report"], order, 1, "_rank")
    first = best.groupBy(F.col("closes").alias("item_id")).agg(F.min(F.struct("told_at", "report"))["report"].alias("closed_by"))
    return items.filter(F.col("kind") == opening).join(first, "item_id", "left")
