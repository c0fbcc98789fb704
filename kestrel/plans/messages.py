"""Queries over messages, with their SQL, which is generated from the same fixed values."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import message_values as V
from kestrel.operators import learn as L
from kestrel.operators import messages as M
from kestrel.sources.bindings import oracle, view


def messages(spark, sf):
    return view(spark, sf, "messages")


def t01_markers(spark, sf):
    return M.detect(messages(spark, sf)).select("doc_id", F.array_join("markers", ",").alias("markers"), F.size("markers").alias("n_markers"))


def t02_first_evidence(spark, sf):
    return M.first_evidence(messages(spark, sf), "doc_id")


def t03_marker_features(spark, sf):
    found = M.marker_features(messages(spark, sf))
    value = lambda k: F.col("marker_features")[k]
    n = len(V.MARKERS)
    flags = [value(k).cast("int").alias(m) for k, m in enumerate(V.MARKERS)]
    return found.select("doc_id", *flags, F.round(value(n), 6).alias("share"), F.round(value(n + 1), 6).alias("completeness"), value(n + 2).cast("int").alias("in_order"))


def t04_scripts(spark, sf):
    # A filter would be pushed below the positions and search every pattern again; a generator is not.
    found = M.scripts(messages(spark, sf)).select("doc_id", F.inline_outer(F.filter(F.array("script"), lambda s: s.isNotNull()))).where("stages IS NOT NULL")
    return found.select("doc_id", "name", "type", "stages", F.round("completeness", 6).alias("completeness"), "in_order", "chain")


def t06_scam_types(spark, sf):
    return M.scam_type(M.detect(messages(spark, sf))).select("doc_id", "scam_type")


def t08_events(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("toxic").cast("int").alias("label"))
    told = messages(spark, sf)
    model = L.message_model(L.with_features(told.join(labels, "doc_id")))
    scored = L.scored(model, told).withColumn("score", F.round("score", 6))
    return M.analysed(scored, "score").select("doc_id", "score", "verdict", "type", "explanation")


def t09_entities(spark, sf):
    return M.entities(messages(spark, sf), "doc_id").groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("entity")), "|").alias("entities"))


def t10_lookalikes(spark, sf):
    urls = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", M.host_of(F.col("url")).alias("own"))
    host = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("paytn."), "own")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("amazom."), "own")).otherwise(F.col("own"))
    return urls.withColumn("host", host).select("page_id", "host", M.lookalike_brand(F.col("host")).alias("brand"))


def t11_branch_codes(spark, sf):
    p = view(spark, sf, "points").select("event_id", F.concat(F.element_at(F.array(*[F.lit(b) for b in [*V.BANKS, "XXXX"]]), F.col("k") % 11 + 1), F.when(F.col("k") % 7 == 0, "9").otherwise("0"), F.lpad((F.col("k") * 77).cast("string"), 6, "0")).alias("code"))
    return p.select("event_id", "code", M.branch_check(F.col("code")).alias("c")).select("event_id", "code", "c.well_formed", "c.bank")


def t12_providers(spark, sf):
    ends = [*V.PROVIDERS[:6], "okhdfcbnk", "payt", "ybk", "gmail"]
    p = view(spark, sf, "points").select("event_id", F.concat(F.lit("u@"), F.element_at(F.array(*map(F.lit, ends)), (F.col("k") % len(ends)) + 1)).alias("handle"))
    return p.select("event_id", M.provider_check(F.col("handle")).alias("c")).select("event_id", "c.provider", "c.known", "c.lookalike_of")


def t13_phone_flags(spark, sf):
    p = view(spark, sf, "points").select("event_id", F.concat(F.when(F.col("k") % 5 == 0, "+91").when(F.col("k") % 5 == 1, "0091 12").otherwise(""), (F.lit(9999999999) - F.pmod(F.col("event_id") * 7919 * F.col("k"), F.lit(8999999999))).cast("string")).alias("phone"))
    return p.select("event_id", "phone", M.phone_flags(F.col("phone")).alias("flags"))


def t14_verification(spark, sf):
    return M.verified(M.entities(messages(spark, sf), "doc_id"), "doc_id")


def t15_other_scripts(spark, sf):
    return messages(spark, sf).select("doc_id", F.col("text").rlike(V.OTHER_SCRIPTS).alias("needs_translation"))


def calls(spark, sf):
    return with_phrases(spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")))


def with_phrases(turns):
    phrase = F.when(F.col("turn") == 1, " This is Inspector Rao calling from CBI.").when(F.col("turn") == 2, " An FIR has been registered against you.").when(F.col("turn") == 3, " Stay on the call and transfer the security deposit now.").otherwise("")
    return turns.withColumn("text", F.concat("text", phrase))


def t16_running_calls(spark, sf):
    found = M.detect(M.running_text(calls(spark, sf)))
    n = F.size("markers")
    stage = F.when(n >= 3, "scam_detected").when(n >= 1, "warning").otherwise("monitoring")
    return found.select("conv_id", "turn", F.array_join("markers", ",").alias("markers"), stage.alias("stage"))


def t17_advice(spark, sf):
    kind = M.verdict((F.col("doc_id") * 37 % 100) / 100, F.size("markers"))
    return M.detect(messages(spark, sf)).select("doc_id", kind.alias("verdict"), M.advice(kind).alias("advice"))


def t18_bigrams(spark, sf):
    return messages(spark, sf).select("doc_id", F.size(M.bigrams(F.col("text"))).alias("bigrams"))


QUERIES = {
    f.__name__: f
    for f in (t01_markers, t02_first_evidence, t03_marker_features, t04_scripts, t06_scam_types, t08_events, t09_entities, t10_lookalikes, t11_branch_codes, t12_providers, t13_phone_flags, t14_verification, t15_other_scripts, t16_running_calls, t17_advice, t18_bigrams)
}


def lit(p: str) -> str:
    return p.replace("'", "''")


#: RE2 has no look-behind: verbs that the first pattern must not follow are masked by as many other characters instead.
BEHIND = r"(?<!not\s)(?<!never\s)"
VERBS = ["share", "send", "provide", "confirm", "verify", "update"]


def masked(text: str = "text") -> str:
    for v in VERBS:
        text = f"regexp_replace({text}, '(?i)(not|never)(\\s){v}\\b', '\\1\\2{'#' * len(v)}', 'g')"
    return text


def hit(p: str, text: str = "text") -> str:
    return f"regexp_matches({masked(text) if BEHIND in p else text}, '(?i){lit(p.replace(BEHIND, ''))}')"


def any_of(ps: list[str], text: str = "text") -> str:
    return "(" + " OR ".join(hit(p, text) for p in ps) + ")"


def at(p: str) -> str:
    """1-based position of the first match, null without one."""
    plain, text = lit(p.replace(BEHIND, "")), masked() if BEHIND in p else "text"
    return f"CASE WHEN {hit(p)} THEN length(regexp_extract({text}, '(?i)^([\\s\\S]*?)(?:{plain})', 1)) + 1 END"


def said(p: str) -> str:
    """The first match, as it stands in the text."""
    plain, text = lit(p.replace(BEHIND, "")), masked() if BEHIND in p else "text"
    return f"trim(substr(text, {at(p)}, length(regexp_extract({text}, '(?i){plain}'))))"


def markers_sql(source: str = "messages", key: str = "doc_id") -> str:
    flags = ", ".join(f"{any_of(ps)} AS {m}" for m, ps in V.MARKERS.items())
    names = "concat_ws(',', " + ", ".join(f"CASE WHEN {m} THEN '{m}' END" for m in V.MARKERS) + ")"
    return f"mk0 AS (SELECT {key}, text, {flags} FROM {source}), mk AS (SELECT *, {names} AS markers, {' + '.join(f'{m}::INT' for m in V.MARKERS)} AS n_markers FROM mk0)"


TYPE_SQL = (
    "CASE WHEN authority_impersonation::INT + fake_fir_or_case::INT + video_call_isolation::INT >= 2 THEN 'digital_arrest' "
    + " ".join(f"WHEN {any_of(cues)} THEN '{k}'" for k, cues in V.TYPE_CUES.items())
    + " WHEN suspicious_link OR personal_data_request THEN 'phishing' WHEN authority_impersonation THEN 'digital_arrest' ELSE 'other' END"
)
VERDICT_SQL = "CASE WHEN (doc_id * 37 % 100) / 100.0e0 >= 0.5343 THEN 'scam' WHEN (doc_id * 37 % 100) / 100.0e0 >= 0.3 THEN 'suspicious' WHEN n_markers >= 3 THEN 'suspicious' ELSE 'legit' END"


def stages_sql() -> str:
    out = []
    for rank, (name, kind, stages) in enumerate(V.SCRIPTS):
        spots = [f"least({', '.join([*(at(p) for m in ms for p in V.MARKERS[m]), *(at(p) for p in own)])}, NULL)" for _, _, ms, own in stages]
        labels = ", ".join(f"CASE WHEN s[{k + 1}] IS NOT NULL THEN 'stage {k + 1} {label}' END" for k, (_, label, _, _) in enumerate(stages))
        out.append(f"SELECT doc_id, '{name}' AS name, '{kind}' AS type, {rank} AS rank, {len(stages)} AS total, s, concat_ws(' -> ', {labels}) AS chain FROM (SELECT doc_id, [{', '.join(spots)}] AS s FROM messages)")
    return (
        "st AS (" + " UNION ALL ".join(out) + "), sm AS (SELECT *, list_filter(s, lambda x: x IS NOT NULL) AS met FROM st), "
        "bs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(met) / total::DOUBLE DESC, rank) AS r FROM sm WHERE len(met) >= 2)"
    )


SCRIPT_SQL = f"WITH {stages_sql()} SELECT doc_id, name, type, CAST(len(met) AS INT) AS stages, round(len(met) / total::DOUBLE, 6) AS completeness, list_sort(met) = met AS in_order, chain FROM bs WHERE r = 1"
EVIDENCE_SQL = "WITH e AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{m}' AS marker, {at(p)} AS place, {said(p)} AS evidence FROM messages" for m, ps in V.MARKERS.items() for p in ps
) + ") SELECT doc_id, marker, CAST(min(place) AS INT) AS place, arg_min(evidence, struct_pack(a := place, b := evidence)) AS evidence FROM e WHERE place IS NOT NULL GROUP BY 1, 2"
BANK_LIST = ", ".join(f"'{b}'" for b in [*V.BANKS, "XXXX"])
CODE_SQL = f"SELECT event_id, ([{BANK_LIST}])[k % 11 + 1] || CASE WHEN k % 7 = 0 THEN '9' ELSE '0' END || lpad(CAST(k * 77 AS VARCHAR), 6, '0') AS code FROM points"
ENDS = [*V.PROVIDERS[:6], "okhdfcbnk", "payt", "ybk", "gmail"]
DOUBLED_PHONE = r"(?:^|[^0-9])((?:(?:\+\+)?91(?:[-\s][-\s])?|0)?[6-9][0-9]{9})(?:$|[^0-9])"
ENTITIES_SQL = f"""wu AS (SELECT doc_id, 'url' AS kind, list_transform(list_filter(regexp_extract_all(text, '(?i){V.URL}', 1), lambda u: NOT contains(u, '@')), lambda u: CASE WHEN starts_with(lower(u), 'http') THEN u ELSE 'http://' || u END) AS l FROM messages
  UNION ALL SELECT doc_id, 'upi', list_filter(regexp_extract_all(text, '(?i){V.HANDLE}', 1), lambda h: lower(string_split(h, '@')[-1]) IN ({', '.join(f"'{x}'" for x in V.PROVIDERS)}) OR lower(string_split(h, '@')[-1]) NOT IN ({', '.join(f"'{x}'" for x in V.MAIL_ENDS)})) FROM messages
  UNION ALL SELECT doc_id, 'ifsc', list_transform(regexp_extract_all(text, '{V.BRANCH}', 1), lambda c: upper(c)) FROM messages
  UNION ALL SELECT doc_id, 'phone', list_transform(regexp_extract_all(regexp_replace(text, '([^0-9])', '\\1\\1', 'g'), '{DOUBLED_PHONE}', 1), lambda x: regexp_replace(x, '([^0-9])[^0-9]', '\\1', 'g')) FROM messages),
we AS (SELECT doc_id, kind, unnest(l) AS entity, generate_subscripts(l, 1) AS pos FROM wu), en AS (SELECT doc_id, kind, arg_min(entity, pos) AS entity FROM we GROUP BY doc_id, kind, lower(entity))"""
BRANDS_SQL = "[" + ", ".join(f"'{b}'" for b in V.BRANDS) + "]"


def brand_sql(host: str) -> str:
    steps = f"""list_transform(string_split({host}, '.'), lambda l: list_transform({BRANDS_SQL}, lambda b: CASE WHEN contains(l, b) OR contains(b, l) THEN '' WHEN abs(length(l) - length(b)) <= 1 AND levenshtein(l, b) BETWEEN 1 AND CASE WHEN length(b) <= 4 THEN 1 ELSE 2 END THEN b END))"""
    return f"CASE WHEN {host} NOT IN ({', '.join(repr(x) for x in V.SHORTENERS)}) THEN nullif(list_filter(flatten({steps}), lambda x: x IS NOT NULL)[1], '') END"


def host_sql(url: str) -> str:
    return f"lower(regexp_extract({url}, '^(?:[A-Za-z]+://)?([^/:?#\\s]+)', 1))"


def phone_sql(phone: str) -> str:
    """(digits d, own number o) of a phone, as a FROM clause's columns, and its flags."""
    digits = f"regexp_replace({phone}, '[^0-9]', '', 'g')"
    own = f"right(ltrim(CASE WHEN length({digits}) > 10 AND starts_with({digits}, '91') THEN substr({digits}, 3) ELSE {digits} END, '0'), 10)"
    return f"""concat_ws(',', CASE WHEN length({digits}) > 12 THEN 'too_long' END, CASE WHEN length({own}) < 10 THEN 'too_short' END, CASE WHEN regexp_matches({own}, '^[1-5]') THEN 'bad_start' END,
        CASE WHEN length({own}) > 0 AND len(list_distinct(string_split({own}, ''))) <= 2 THEN 'few_digits' END)"""


PHONES_SQL = """SELECT event_id, CASE k % 5 WHEN 0 THEN '+91' WHEN 1 THEN '0091 12' ELSE '' END || CAST(9999999999 - (event_id * 7919 * k) % 8999999999 AS VARCHAR) AS phone FROM points"""
PROVIDER_LIST, BANK_CODES = (", ".join(f"'{x}'" for x in names) for names in (V.PROVIDERS, V.BANKS))
ORACLES = {
    "t09_entities": oracle(f"WITH {ENTITIES_SQL} SELECT doc_id, kind, count(*) AS n, string_agg(entity, '|' ORDER BY entity) AS entities FROM en GROUP BY 1, 2", "messages"),
    "t10_lookalikes": f"""WITH u AS (SELECT page_id, {host_sql('url')} AS own FROM pages), h AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'paytn.' || own WHEN 1 THEN 'amazom.' || own ELSE own END AS host FROM u)
        SELECT page_id, host, {brand_sql('host')} AS brand FROM h""",
    "t13_phone_flags": oracle(f"WITH p AS ({PHONES_SQL}) SELECT event_id, phone, {phone_sql('phone')} AS flags FROM p", "points"),
    "t14_verification": oracle(f"""WITH {ENTITIES_SQL}, eh AS (SELECT *, {host_sql('entity')} AS host, lower(string_split(entity, '@')[-1]) AS provider, {phone_sql('entity')} AS flags FROM en),
        nt AS (SELECT doc_id, CASE WHEN kind = 'url' AND {brand_sql('host')} IS NOT NULL THEN 'link imitates ' || {brand_sql('host')} WHEN kind = 'upi' AND provider NOT IN ({PROVIDER_LIST}) THEN 'unknown provider ' || provider
          WHEN kind = 'ifsc' AND NOT (regexp_full_match(entity, '[A-Z]{{4}}0[A-Z0-9]{{6}}') AND substr(entity, 1, 4) IN ({BANK_CODES})) THEN 'unknown bank code' WHEN kind = 'phone' AND flags <> '' THEN flags END AS note FROM eh)
        SELECT doc_id, count(*) AS entities, count(note) AS suspicious, coalesce(array_to_string(list_sort(list_distinct(list(note) FILTER (WHERE note IS NOT NULL)))[1:3], '; '), '') AS highlights FROM nt GROUP BY 1""", "messages"),
    "t01_markers": oracle(f"WITH {markers_sql()} SELECT doc_id, markers, n_markers FROM mk", "messages"),
    "t02_first_evidence": oracle(EVIDENCE_SQL, "messages"),
    "t03_marker_features": oracle(f"WITH {markers_sql()}, s AS ({SCRIPT_SQL}) SELECT mk.doc_id, {', '.join(f'{m}::INT AS {m}' for m in V.MARKERS)}, round(least(n_markers, 5) / 5.0e0, 6) AS share, coalesce(completeness, 0e0) AS completeness, coalesce(in_order::INT, 0) AS in_order FROM mk LEFT JOIN s ON s.doc_id = mk.doc_id", "messages"),
    "t04_scripts": oracle(SCRIPT_SQL, "messages"),
    "t06_scam_types": oracle(f"WITH {markers_sql()} SELECT doc_id, {TYPE_SQL} AS scam_type FROM mk", "messages"),
    "t11_branch_codes": oracle(f"SELECT event_id, code, regexp_full_match(code, '[A-Z]{{4}}0[A-Z0-9]{{6}}') AS well_formed, CASE WHEN regexp_full_match(code, '[A-Z]{{4}}0[A-Z0-9]{{6}}') THEN CASE substr(code, 1, 4) {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in V.BANKS.items())} END END AS bank FROM ({CODE_SQL})", "points"),
    "t12_providers": oracle(f"""WITH p AS (SELECT event_id, ([{', '.join(f"'{e}'" for e in ENDS)}])[k % {len(ENDS)} + 1] AS provider FROM points), k(p) AS (VALUES {', '.join(f"('{x}')" for x in V.PROVIDERS)})
        SELECT event_id, provider, provider IN (SELECT p FROM k) AS known, CASE WHEN provider NOT IN (SELECT p FROM k) THEN (SELECT arg_min(p, struct_pack(a := levenshtein(provider, p), b := p)) FROM k WHERE levenshtein(provider, p) BETWEEN 1 AND 2) END AS lookalike_of FROM p""", "points"),
    "t15_other_scripts": oracle(f"SELECT doc_id, regexp_matches(text, '{V.OTHER_SCRIPTS}') AS needs_translation FROM messages", "messages"),
    "t16_running_calls": oracle(f"""WITH c0 AS (SELECT conv_id, turn, coalesce(text, '') || CASE turn WHEN 1 THEN ' This is Inspector Rao calling from CBI.' WHEN 2 THEN ' An FIR has been registered against you.'
        WHEN 3 THEN ' Stay on the call and transfer the security deposit now.' ELSE '' END AS text FROM conversations), c AS (SELECT conv_id, turn, string_agg(text, ' ' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS text FROM c0),
        {markers_sql('c', 'conv_id, turn')} SELECT conv_id, turn, markers, CASE WHEN n_markers >= 3 THEN 'scam_detected' WHEN n_markers >= 1 THEN 'warning' ELSE 'monitoring' END AS stage FROM mk"""),
    "t17_advice": oracle(f"""WITH {markers_sql()}, v AS (SELECT doc_id, {VERDICT_SQL} AS verdict FROM mk) SELECT doc_id, verdict, CASE verdict WHEN 'scam' THEN 'This is a scam. Hang up, pay nothing and report it on 1930.'
        WHEN 'suspicious' THEN 'Be careful: verify the caller on an official number before you act.' ELSE 'No known scam pattern was found.' END AS advice FROM v""", "messages"),
    "t18_bigrams": oracle("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z]{3,})', 1) AS w FROM messages)
        SELECT doc_id, CAST((SELECT count(DISTINCT w[i] || ' ' || w[i + 1]) FROM (SELECT unnest(generate_series(1, len(w) - 1)) AS i)) AS INT) AS bigrams FROM w""", "messages"),
}
