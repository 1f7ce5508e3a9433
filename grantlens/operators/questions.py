"""Reading questions and finding the closest known one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from grantlens.functions import categories as C
from grantlens.functions.banding import js_round
from grantlens.functions.text import group, java, matches
from grantlens.operators.eligibility import rank_schemes
from grantlens.operators.profiles import standardize_profiles
from grantlens.rules import corpus as Q, utterances as U
from grantlens.rules.relations import literal_array
from grantlens.session import durable


# --- Q1, U2 ---------------------------------------------------------------------------
def tokens(text: Column, min_length: int = 1, stop_words: bool = False) -> Column:
    """ASCII word tokens in lower case, duplicates kept."""
    raw = F.split(F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\s]", " "), r"\s+")
    if not stop_words:
        return F.filter(raw, lambda w: F.length(w) >= min_length)
    return F.filter(raw, lambda w: (F.length(w) >= min_length) & ~w.isin(*Q.STOP_WORDS))


def question_tokens(text: Column) -> Column:
    return tokens(text, 2, stop_words=True)


def token_counts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Q1: sizes of the three token variants of every text."""
    t = F.col(text)
    return df.select(key, F.size(tokens(t)).alias("n_tokens"), F.size(tokens(t, 3)).alias("n_long_tokens"),
                     F.size(question_tokens(t)).alias("n_content_tokens"), F.size(F.array_distinct(question_tokens(t))).alias("n_distinct_content"))


# --- Q2 -------------------------------------------------------------------------------
def extract_income(text: Column) -> Column:
    """Yearly income in rupees; the first pattern that matches decides, even if its number is unusable."""
    return _income_in(F.lower(text))


def _income_in(norm: Column) -> Column:
    out = None
    for pattern, has_unit in U.INCOME_PATTERNS:
        number = F.replace(F.regexp_extract(norm, java(pattern), 1), F.lit(","), F.lit("")).try_cast("double")
        unit = F.regexp_extract(norm, java(pattern), 2) if has_unit else F.lit("")
        factor = F.when(unit.isin(*U.LAKH_UNITS), 100_000.0).when(unit.isin(*U.THOUSAND_UNITS), 1_000.0).otherwise(1.0)
        value = js_round(number * factor)
        stated = matches(norm, pattern, low=norm)
        out = F.when(stated, value) if out is None else out.when(stated, value)
    return out


# --- Q3 -------------------------------------------------------------------------------
def _first_listed(norm: Column, names: list[tuple[str, str]]) -> Column:
    """The first name of the list that occurs as whole words; one pass over the text finds them all."""
    order = {written: i for i, (written, _) in enumerate(names)}
    alternatives = "|".join(re.escape(w) for w, _ in sorted(names, key=lambda n: -len(n[0])))
    found = F.regexp_extract_all(norm, F.lit(java(rf"\b({alternatives})\b", ignore_case=False)), F.lit(1))
    position = F.array_min(F.transform(found, lambda f: C.lookup(f, {k: f"{v:03d}" for k, v in order.items()})))
    return F.when(F.size(found) > 0, F.get(F.array(*[F.lit(v) for _, v in names]), position.cast("int")))


def slot_columns(norm: Column) -> dict[str, Column]:
    """The slots of a text in lower case."""
    has = lambda p: matches(norm, p, ignore_case=False, low=norm)
    category = None
    for name, pattern, unless in U.CATEGORY_SLOTS:
        test = has(pattern) & ~has(unless) if unless else has(pattern)
        category = F.when(test, name) if category is None else category.when(test, name)
    district = _first_listed(norm, [(d.lower(), d) for d in C.DISTRICTS])
    named_state = _first_listed(norm, [(re.sub("[^a-z]", " ", s.lower()).strip(), s) for s in C.STATES])
    alias = C.choose(U.STATE_ALIASES, has)
    quota = has(U.QUOTA_75)
    school = has(U.SCHOOL) | (has(U.SCHOOL_WORD) & ~has(U.STATE_SCHOOL))
    arts = has(U.ARTS) & ~has(U.ARTS_UNLESS)
    courses = [("Engineering", has(U.ENGINEERING), F.lit("ug")), ("Medical", has(U.MEDICAL), F.lit("ug")),
               ("Diploma", has(U.DIPLOMA), F.when(has(r"\biti\b"), "iti").otherwise("diploma")), ("School", school, F.lit("prematric")),
               ("Science", has(U.SCIENCE), F.when(has(r"\bmsc\b"), "pg").otherwise("ug")), ("Arts", arts, F.lit("ug"))]
    course = level = None
    for name, test, its_level in courses:
        course = F.when(test, name) if course is None else course.when(test, name)
        level = F.when(test, its_level) if level is None else level.when(test, its_level)
    percent = F.coalesce(*[group(norm, p).cast("int") for p in U.DISABILITY_PERCENT])
    govt = has(U.GOVT_SCHOOL)
    before_school = F.coalesce(alias, F.when(district.isNotNull(), "Tamil Nadu"), named_state, F.when(quota, "Tamil Nadu"))
    return {
        "category": category, "community": F.lower(category), "district": district,
        "state": F.coalesce(before_school, F.when(govt, "Tamil Nadu")),
        "govt_school_quota": F.when(quota, True), "course": F.when(~quota, course),
        "level": F.when(~quota, F.coalesce(level, C.to_level(norm))),
        "gender": F.when(has(U.GIRLS), "Girls").when(has(U.BOYS), "Boys"),
        "disability_percent": percent,
        "disabled": F.when(percent.isNotNull(), percent >= 40).when(has(U.DISABLED), True),
        "govt_school": F.when(govt | quota, True).when(has(U.OTHER_SCHOOL), False),
        "agri_labor": F.when(has(U.AGRI_LABOR), True), "armed_forces": F.when(has(U.ARMED_FORCES), True),
        "first_graduate": F.when(has(U.FIRST_GRADUATE), True), "income": _income_in(norm),
    }


def extract_slots(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Q3: everything a question states about its author. A private-school word overrides the quota's school answer."""
    norm = F.col("norm")
    cols = slot_columns(norm)
    has = lambda p: matches(norm, p, False, low=norm)
    first = df.select(key, text, F.lower(text).alias("norm"))
    first = first.select(key, text, *[c.alias(n) for n, c in cols.items() if n != "govt_school"], has(U.GOVT_SCHOOL).alias("govt"), has(U.OTHER_SCHOOL).alias("other"))
    return first.withColumn("govt_school", F.when(F.col("govt"), True).when(F.col("other"), False).when(F.col("govt_school_quota"), True)).drop("govt", "other")


# --- Q4, J12 --------------------------------------------------------------------------
def extract_entities(text: Column) -> Column:
    """Acronyms named in the text, in table order."""
    norm = F.lower(text)
    return F.array_compact(F.array(*[F.when(matches(norm, rf"\b{a.lower()}\b", False), a) for a, _ in U.ACRONYMS]))


def asks_full_form(text: Column) -> Column:
    norm = F.trim(F.lower(text))
    return matches(norm, U.FULL_FORM_TRIGGERS) | matches(norm, U.BARE_ACRONYM)


def expand_acronyms(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per question that asks for full forms, with the forms it asks for."""
    asked = df.select(key, extract_entities(F.col(text)).alias("entities"), asks_full_form(F.col(text)).alias("asks")).filter("asks and size(entities) > 0")
    forms = dict(U.ACRONYMS)
    return asked.select(
        key, F.when(F.size("entities") > 1, "multi").otherwise("single").alias("kind"), F.array_join("entities", ",").alias("acronyms"),
        F.array_join(F.transform("entities", lambda e: C.lookup(e, forms)), "; ").alias("full_forms"))


# --- Q5 -------------------------------------------------------------------------------
_PHRASE_TYPES = {"ord": "int", "intent_no": "int", "intent": "string", "phrase": "string", "pattern": "string", "weight": "int", "is_priority": "boolean"}


def _phrase_array(rows: list[dict]) -> Column:
    full = [{**r, "pattern": rf"(^|[^a-z0-9]){re.escape(r['phrase'])}($|[^a-z0-9])"} for r in rows]
    return F.expr(literal_array(full, _PHRASE_TYPES))


def detect_intent(df: DataFrame, key: str, text: str = "text", phrases: list[dict] | None = None, keep: list[Column] | None = None) -> DataFrame:
    """Q5: first priority phrase, else eligibility when facts are stated, else the intent with most points.

    Phrases are looked up by substring first; only those found are tested for word edges.
    """
    rows = U.phrase_rows() if phrases is None else phrases
    low = F.col("low")
    slots = slot_columns(low)
    found = F.filter(_phrase_array(rows), lambda p: low.contains(p.getField("phrase")) & F.rlike(low, p.getField("pattern")))
    wanted = None
    for word in U.ELIGIBILITY_WORDS:
        wanted = low.contains(word) if wanted is None else wanted | low.contains(word)
    stated = slots["category"].isNotNull() | slots["disabled"].isNotNull()
    asks = stated & (wanted | slots["income"].isNotNull() | slots["disabled"].isNotNull())
    lowered = df.select("*", F.lower(text).alias("low"))
    base = lowered.select(key, *(keep or []), found.alias("hits"), asks.alias("asks"))
    first = F.get(F.filter("hits", lambda h: h.getField("is_priority")), F.lit(0)).getField("intent")
    scored = F.filter("hits", lambda h: ~h.getField("is_priority"))
    points = F.transform(scored, lambda h: F.struct(
        F.aggregate(F.filter(scored, lambda g: g.getField("intent_no") == h.getField("intent_no")), F.lit(0), lambda a, g: a + g.getField("weight")).alias("points"),
        (-h.getField("intent_no")).alias("order"), h.getField("intent").alias("intent")))
    kept = [c for c in base.columns if c not in ("hits", "asks")]
    return base.select(*kept, F.coalesce(first, F.when(F.col("asks"), "eligibility"), F.array_max(points).getField("intent"), F.lit("unknown")).alias("intent"))


# --- J11 ------------------------------------------------------------------------------
def normal_question(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text)), "[?.,!]", "")


def priority_id(norm: Column) -> Column:
    out = None
    for pattern, target in Q.PRIORITY_PHRASES:
        out = F.when(matches(norm, pattern), target) if out is None else out.when(matches(norm, pattern), target)
    return out


#: A text inside another one shares all of its tokens but for those cut at its two ends.
CUT_TOKENS = 2


def _item_index(corpus: DataFrame) -> DataFrame:
    """(token, c_ord, c_distinct, n, anchor): the items of each token, how many there are, and whether the token is among its item's rarest."""
    c = corpus.select("c_ord", F.array_distinct("c_tokens").alias("t")).select("c_ord", F.size("t").alias("c_distinct"), "t").select("c_ord", "c_distinct", F.explode("t").alias("token"))
    by_rarity = Window.partitionBy("c_ord").orderBy("n", "token")
    return c.join(c.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token").withColumn("anchor", F.row_number().over(by_rarity) <= CUT_TOKENS + 1)


def _query_index(queries: DataFrame, index: DataFrame, least: float) -> DataFrame:
    """(q_id, q_distinct, token, times, probes, rest, n_rest): the tokens of each query that items have, with repeats.

    Tokens are ordered by how many items have them. The most frequent ones whose repeats together can't reach the score `least`
    alone don't probe; `rest` and `n_rest` are their repeats and their number. A query that may lie inside an item probes
    with its rarest tokens too.
    """
    known = index.select("token", "n").distinct()
    q = queries.select("q_id", F.size(F.array_distinct("q_tokens")).alias("q_distinct"), "q_tokens").select("q_id", "q_distinct", F.explode("q_tokens").alias("token"))
    q = q.join(known, "token").groupBy("q_id", "q_distinct", "token", "n").agg(F.count(F.lit(1)).alias("times"))
    whole = Window.partitionBy("q_id")
    frequent_first = whole.orderBy(F.col("n").desc(), "token")
    q = q.withColumns({
        "upto": F.sum("times").over(frequent_first.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(frequent_first), "present": F.count(F.lit(1)).over(whole)})
    inside = (F.col("present") >= F.col("q_distinct") - CUT_TOKENS) & (F.col("present") - F.col("place") <= CUT_TOKENS)
    q = q.withColumn("probes", inside | (F.col("upto") >= least * F.col("q_distinct") - 1e-9))
    spare = lambda c: F.sum(F.when(~F.col("probes"), c).otherwise(0)).over(whole)
    return q.select("q_id", "q_distinct", "token", "times", "probes", spare(F.col("times")).alias("rest"), spare(F.lit(1)).alias("n_rest"))


def token_overlap(queries: DataFrame, corpus: DataFrame, least: float = Q.MIN_SCORE) -> DataFrame:
    """Scores (q_id, c_ord, score) of (q_id, norm, q_tokens) against (c_ord, question, c_tokens), whole for all pairs that may be a query's best and reach `least`.

    A prefix index: of a query's tokens, rarest first, only those probe the items that a pair must share
    one of to reach `least`; the most frequent ones meet an item through its rarest tokens alone, which finds the
    pairs of a text inside another. Pairs whose probed tokens and the query's other ones could reach both `least` and what
    the query's best item has already are verified once: the other tokens are looked up by item and token. So a word of
    every query and every item doesn't bring them all together. Texts are fetched only for pairs whose shared tokens allow containment.
    """
    c = durable(_item_index(corpus))
    q = durable(_query_index(queries, c, least))
    by_probe = q.filter("probes").join(c, "token")
    by_anchor = q.filter(~F.col("probes")).join(c.filter("anchor"), "token")
    met = by_probe.unionByName(by_anchor).groupBy("q_id", "c_ord", "q_distinct", "c_distinct", "rest", "n_rest").agg(
        F.sum("times").alias("hits"), F.count(F.lit(1)).alias("shared"), F.count_if(~F.col("probes")).alias("by_anchor"))
    union = F.col("q_distinct") + F.col("c_distinct") - F.col("shared")
    most_shared = F.col("shared") + F.col("n_rest") - F.col("by_anchor")
    may_lie_inside = (most_shared >= F.col("c_distinct") - CUT_TOKENS) | (most_shared >= F.col("q_distinct") - CUT_TOKENS)
    most = (F.col("hits") + F.col("rest")) / F.greatest(F.lit(1), F.col("q_distinct") + F.col("c_distinct") - most_shared)
    most = most + F.when(may_lie_inside, Q.CONTAINMENT_BONUS).otherwise(0.0)
    # What is found already is a score that the best item has at least.
    reached = F.greatest(F.max(F.col("hits") / union).over(Window.partitionBy("q_id")), F.lit(least))
    kept = met.withColumn("reached", reached).filter(most >= F.col("reached") - 1e-9)
    others = q.filter(~F.col("probes")).select("q_id", "token", "times").join(kept.filter("n_rest > by_anchor").select("q_id", "c_ord"), "q_id")
    others = others.join(c.filter(~F.col("anchor")).select("token", "c_ord"), ["token", "c_ord"])
    rows = kept.select("q_id", "c_ord", "q_distinct", "c_distinct", "hits", "shared").unionByName(
        others.select("q_id", "c_ord", F.lit(None).cast("int").alias("q_distinct"), F.lit(None).cast("int").alias("c_distinct"), F.col("times").alias("hits"), F.lit(1).cast("long").alias("shared")))
    sized = rows.groupBy("q_id", "c_ord").agg(*[F.max(n).alias(n) for n in ("q_distinct", "c_distinct")], F.sum("hits").alias("hits"), F.sum("shared").alias("shared"))
    sized = sized.withColumn("score", F.col("hits") / union)
    containable = (F.col("shared") >= F.col("c_distinct") - CUT_TOKENS) | (F.col("shared") >= F.col("q_distinct") - CUT_TOKENS)
    asked = sized.filter(containable).select("q_id", "c_ord").join(corpus.select("c_ord", "question"), "c_ord").join(queries.select("q_id", "norm"), "q_id")
    low = F.lower("question")
    inside = asked.filter(F.col("norm").contains(low) | low.contains(F.col("norm"))).select("q_id", "c_ord", F.lit(Q.CONTAINMENT_BONUS).alias("bonus"))
    return sized.select("q_id", "c_ord", "score").join(inside, ["q_id", "c_ord"], "left").select("q_id", "c_ord", (F.col("score") + F.coalesce("bonus", F.lit(0.0))).alias("score"))


def _row_score(norm: Column, q_tokens: Column, question: Column, c_tokens: Column) -> Column:
    hits = F.size(F.filter(q_tokens, lambda t: F.array_contains(c_tokens, t)))
    bonus = F.when(norm.contains(F.lower(question)) | F.lower(question).contains(norm), Q.CONTAINMENT_BONUS).otherwise(0.0)
    return F.when(hits > 0, hits / F.size(F.array_union(q_tokens, c_tokens)) + bonus)


def guarded_overlap(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Templated questions count only if the query names their state, category and course.

    The guard becomes the join key: each query is expanded to the few combinations it
    names, so no query meets the whole matrix.
    """
    norm = F.col("norm")
    named = lambda values, test: F.array_compact(F.array(*[F.when(test(v), v) for v in values]))
    letters = lambda s: re.sub("[^a-z]", " ", s.lower()).strip()
    states = named(Q.STATES, lambda s: F.lit(True) if s.lower() == Q.UNGUARDED_STATE else norm.contains(letters(s)))
    categories = named(Q.CATEGORIES, lambda c: matches(norm, rf"\b{c.lower()}\b"))
    courses = named(Q.COURSES, lambda c: norm.contains(c.lower()))
    expanded = (
        queries.withColumn("category", F.explode(categories)).withColumn("course", F.explode(courses)).withColumn("state", F.explode(states)))
    joined = expanded.join(corpus, ["state", "category", "course"])
    scored = joined.select("q_id", "c_ord", _row_score(norm, F.col("q_tokens"), F.col("question"), F.col("c_tokens")).alias("score"))
    return scored.filter("score is not null")


def best_match(scored: DataFrame) -> DataFrame:
    """Highest score per query; the earlier corpus row wins ties."""
    best = scored.groupBy("q_id").agg(F.max_by(F.struct("c_ord", "score"), F.struct("score", -F.col("c_ord"))).alias("b"))
    return best.filter(F.col("b.score") >= Q.MIN_SCORE).select("q_id", "b.c_ord", "b.score")


def prepare_corpus(corpus: DataFrame) -> DataFrame:
    """Corpus rows (id, question, category, state, course) with their order and tokens; ids are the order."""
    return corpus.withColumns({"c_ord": F.col("id"), "c_tokens": question_tokens(F.col("question")), "c_norm": normal_question(F.col("question"))})


def match_questions(queries: DataFrame, corpus: DataFrame, key: str, text: str = "text", use_priority: bool = True) -> DataFrame:
    """Exact question, then priority phrase, then best token overlap.

    Each tier only sees the queries the tiers before left open. Identical questions are
    answered once and joined back, so a question asked by everyone is matched once.
    """
    asked = df_norm(queries, key, text)
    known = prepare_corpus(corpus)
    exact = known.groupBy(F.col("c_norm").alias("norm")).agg(F.min("c_ord").alias("exact_id"))
    wanted = priority_id(F.col("norm")) if use_priority else F.lit(None).cast("int")
    staged = asked.select("norm").distinct().join(exact, "norm", "left").withColumn("wanted", wanted)
    staged = staged.join(known.select(F.col("c_ord").alias("phrase_id")), F.col("wanted") == F.col("phrase_id"), "left")
    staged = durable(staged.select("norm", "exact_id", "phrase_id", F.when(
        F.col("exact_id").isNull() & F.col("phrase_id").isNull(), question_tokens(F.col("norm"))).alias("q_tokens")))
    decided = staged.filter("q_tokens is null").select(
        "norm", F.coalesce("exact_id", "phrase_id").cast("bigint").alias("matched_id"),
        F.when(F.col("exact_id").isNotNull(), Q.EXACT_SCORE).otherwise(Q.PRIORITY_SCORE).alias("score"),
        F.when(F.col("exact_id").isNotNull(), "exact").otherwise("phrase").alias("tier"))
    open_queries = staged.filter("q_tokens is not null").select(F.col("norm").alias("q_id"), "norm", "q_tokens")
    free, guarded = known.filter(F.col("id") < Q.GUARDED_FROM_ID), known.filter(F.col("id") >= Q.GUARDED_FROM_ID)
    if "course" in corpus.columns:
        scored = token_overlap(open_queries, free).unionByName(guarded_overlap(open_queries, guarded))
    else:
        scored = token_overlap(open_queries, known)
    overlapped = best_match(scored).select(F.col("q_id").alias("norm"), F.col("c_ord").cast("bigint").alias("matched_id"), "score", F.lit("overlap").alias("tier"))
    return asked.join(decided.unionByName(overlapped), "norm").select(key, "matched_id", "score", "tier")


def df_norm(queries: DataFrame, key: str, text: str) -> DataFrame:
    return queries.select(key, normal_question(F.col(text)).alias("norm")).filter("norm <> ''")


def match_texts(texts: DataFrame, items: DataFrame, key: str, item_key: str, text: str = "text") -> DataFrame:
    """J11's overlap tier between long texts and a small item table: the best item of every text."""
    q = texts.select(F.col(key).alias("q_id"), normal_question(F.col(text)).alias("norm")).withColumn("q_tokens", question_tokens(F.col("norm")))
    c = items.select(F.col(item_key).alias("c_ord"), F.col(text).alias("question"), question_tokens(F.col(text)).alias("c_tokens"))
    return best_match(token_overlap(q, c)).select(F.col("q_id").alias(key), F.col("c_ord").alias(item_key), "score")


# --- Q6 -------------------------------------------------------------------------------
def asks_purpose(text: Column) -> Column:
    norm = F.regexp_replace(F.lower(text), "['’]", "")
    norm = F.trim(F.regexp_replace(F.regexp_replace(norm, r"[^A-Za-z0-9_\s%]", " "), r"\s+", " "))
    has = {k: matches(norm, p) for k, p in U.PURPOSE_WORDS.items()}
    excluded = matches(norm, U.PURPOSE_WAY[0]) & matches(norm, U.PURPOSE_WAY[1])
    for p in U.PURPOSE_EXCLUDES:
        excluded = excluded | matches(norm, p)
    about = has["scholarship"] | has["participation"]
    phrased = None
    for p in U.PURPOSE_PHRASES:
        phrased = matches(norm, p) if phrased is None else phrased | matches(norm, p)
    yes = (
        (has["why"] & about)
        | ((has["benefit"] | has["purpose"] | has["importance"] | has["value"]) & about)
        | ((has["utility"] | has["value"] | has["need"] | has["importance"]) & (has["scholarship"] | (has["need"] & has["participation"])))
        | (has["scholarship"] & has["utility"]) | (about & phrased)
    )
    return ~excluded & yes


def route_queries(df: DataFrame, corpus: DataFrame, key: str, text: str = "text", phrases: list[dict] | None = None) -> DataFrame:
    """Q6: the route of every question, cheapest tests first; only questions still open reach the corpus."""
    query = F.trim(F.col(text))
    entities = extract_entities(query)
    norm = F.lower(query)
    apply = matches(norm, U.HOW_TO_APPLY) | norm.isin("apply", "how to apply?", "how to apply")
    target = None
    for name, p in U.APPLY_TARGETS:
        target = F.when(matches(norm, p), name) if target is None else target.when(matches(norm, p), name)
    early = (
        F.when(matches(query, U.GREETING), "greeting").when(matches(query, U.IDENTITY), "bot_identity").when(matches(query, U.QUOTA_75), "quota_7_5")
        .when(asks_purpose(query), "scholarship_purpose").when(asks_full_form(query) & (F.size(entities) > 0), "full_form").when(apply, target.otherwise("apply_general"))
    )
    base = df.filter(F.trim(text) != "").select(key, text, early.alias("early"))
    open_rows = base.filter("early is null")
    slots = slot_columns(F.col("low"))
    states_facts = F.coalesce(slots["category"].isNotNull() | slots["income"].isNotNull() | slots["disabled"].isNotNull(), F.lit(False))
    with_intent = detect_intent(open_rows, key, text, phrases, keep=[F.col(text), states_facts.alias("facts")])
    late = F.when(~F.col("intent").isin(*U.ANSWERED_ELSEWHERE), F.col("intent")).when((F.col("intent") == "eligibility") | F.col("facts"), "eligibility")
    routed = durable(with_intent.select(key, text, "intent", late.alias("late")))
    asked = match_questions(routed.filter("late is null").select(key, text), corpus, key, text).filter("score >= 0.25").select(key, F.lit("qa_match").alias("qa"))
    rest = routed.join(asked, key, "left").select(key, F.coalesce("late", "qa", "intent").alias("route"))
    return base.filter("early is not null").select(key, F.col("early").alias("route")).unionByName(rest)


# --- Q7 -------------------------------------------------------------------------------
def screen_utterances(df: DataFrame, key: str, text: str = "text", assume_government_quota: bool = False, top_k: int = 4) -> DataFrame:
    """Q7: schemes for the facts stated in a question. An unstated quota stays unknown unless asked otherwise."""
    slots = extract_slots(df, key, text).drop(text)
    profiles = standardize_profiles(slots, key)
    if assume_government_quota:
        profiles = profiles.withColumn("quota_type", F.when(F.col("quota_type") == "unknown", "government").otherwise(F.col("quota_type")))
    return rank_schemes(profiles, key=key, top_k=top_k).filter(F.col("status").isin("CONFIRMED MATCH", "POTENTIAL MATCH"))
