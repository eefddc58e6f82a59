"""SQL that gives the core queries' results, each over whole tables, for an engine with standard functions."""

from __future__ import annotations

from cowrie.functions.text import ALLOWED_CLASS, LOAN_PATTERN, STOPWORDS

from . import settings as S

WS = r"[\t-\r \x{85}\p{Z}]+"
FINAL = "(SELECT DISTINCT ON (id) * FROM final_record)"


def _ranked(order: str, table: str = "working_record", key: str = "id") -> str:
    return f"(SELECT * EXCLUDE (_k) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS _k FROM {table}) WHERE _k = 1)"


WORK = _ranked("received_at DESC NULLS LAST, updated_at DESC NULLS LAST")
EARLY = _ranked("received_at ASC NULLS LAST, updated_at ASC NULLS LAST")
JUDGED = _ranked("submitted_at DESC NULLS LAST, received_at DESC NULLS LAST, harm DESC NULLS LAST", "unblinded_rating", "sample_id, system_id, rater_id")
RATED = f"(SELECT sample_id, system_id, rater_id, e.key AS dimension, e.value AS value FROM (SELECT *, unnest(map_entries(ratings)) AS e FROM {JUDGED}) WHERE e.value BETWEEN 1 AND 5)"
ANSWERS = f"""(SELECT o.sample_id, o.system_id, o.hypothesis, f.output AS reference, coalesce(lower(trim(f.topic)), 'unknown') AS topic
  FROM (SELECT sample_id, system_id, min(response_yo) AS hypothesis FROM unblinded_rating GROUP BY 1, 2) o JOIN {FINAL} f ON f.id = o.sample_id)"""
TOPIC = "coalesce(lower(trim(topic)), 'unknown')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _blank(c: str) -> str:
    return f"(CASE WHEN trim(regexp_replace({c}, '{WS}', ' ', 'g')) <> '' THEN {c} END)"


def _tokens(c: str) -> str:
    clean = f"trim(regexp_replace(coalesce({c}, ''), '{WS}', ' ', 'g'))"
    return f"(CASE WHEN {clean} = '' THEN []::VARCHAR[] ELSE string_split({clean}, ' ') END)"


def _legal(c: str) -> str:
    return f"NOT regexp_matches(regexp_replace({c}, {_q(LOAN_PATTERN)}, ' ', 'g'), {_q(f'[^{ALLOWED_CLASS}]')})"


def _words(c: str) -> str:
    outer = _q("^[.,;:!?'\"()]+|[.,;:!?'\"()]+$")
    return f"list_filter(list_transform({_tokens(f'nfc_normalize({c})')}, lambda t: regexp_replace(t, {outer}, '', 'g')), lambda t: t <> '')"


def _foreign(c: str) -> str:
    words = _words(c)
    return f"({c} <> '' AND (CASE WHEN len({words}) > 0 THEN CAST(len(list_filter({words}, lambda t: {_legal('t')})) AS DOUBLE) / len({words}) ELSE 0 END) < 0.5)"


def _names() -> str:
    return "(VALUES " + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in S.TOPIC_NAMES.items()) + ") AS names(topic, name)"


def _classify() -> str:
    arms = []
    for c in S.CATEGORIES:
        hit = "(" + " OR ".join(f"contains(low, {_q(t)})" for t in c.triggers) + ")"
        if c.only:
            hit += " AND name IN (" + ", ".join(map(_q, c.only)) + ")"
        if c.never:
            hit += " AND name NOT IN (" + ", ".join(map(_q, c.never)) + ")"
        arms.append(f"WHEN {hit} THEN {_q(c.name)}")
    return "CASE " + " ".join(arms) + " END"


def _question() -> str:
    return "CASE " + " ".join(f"WHEN kind = {_q(c.name)} THEN {_q(c.template)}" for c in S.CATEGORIES) + f" ELSE {_q(S.GENERIC)} END"


def _hash(key: str, seed: int = S.SEED) -> str:
    return f"md5('{seed}|' || {key})"


def _sampled(source: str, fraction: str) -> str:
    return f"SELECT id, topic FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY {_hash('id')}, id) AS r, count(*) OVER (PARTITION BY topic) AS n FROM {source}) WHERE r <= greatest(1, CAST(round_even(n * {fraction}, 0) AS BIGINT))"


def _hit(c: str, words: tuple[str, ...]) -> str:
    single = [w for w in words if " " not in w]
    toks = f"list_transform({_tokens(c)}, lambda t: regexp_replace(t, '[!-/:-@\\[-`{{-~]', '', 'g'))"
    parts = [f"list_has_any({toks}, [{', '.join(map(_q, single))}])", *[f"contains({c}, {_q(w)})" for w in words if " " in w]]
    return "(" + " OR ".join(parts) + ")"


KEYED = rf"""(SELECT * FROM (SELECT * EXCLUDE (claim_id, flat, num), CASE WHEN regexp_matches(flat, '-[0-9]+$') THEN regexp_replace(flat, '-[0-9]+$', '') || '-' || CASE WHEN length(num) < 3 THEN lpad(num, 3, '0') ELSE num END ELSE flat END AS claim_id
  FROM (SELECT *, regexp_replace(regexp_extract(flat, '-([0-9]+)$', 1), '^0+([0-9])', '\1') AS num FROM (SELECT *, regexp_replace(regexp_replace(lower(claim_id), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS flat FROM {FINAL}))) WHERE claim_id <> '')"""
GROUPS = f"(SELECT claim_id, first(topic ORDER BY id, topic) AS stratum FROM {KEYED} GROUP BY claim_id)"
OWN_SPLIT = f"""(SELECT claim_id, stratum, CASE WHEN r <= round_even(n * 0.8, 0) THEN 'train' WHEN r <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_hash('claim_id')}, claim_id) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM {GROUPS}))"""
BLINDED = f"""(SELECT sample_id, substr('ABCDEFGH', CAST(row_number() OVER (PARTITION BY sample_id ORDER BY md5('{S.SEED}|' || sample_id || '|' || system_id), system_id) AS BIGINT), 1) AS slot, system_id
  FROM (SELECT DISTINCT id AS sample_id FROM final_record WHERE split = 'test'), (VALUES {', '.join(f"({_q(s)})" for s in S.SYSTEMS)}) AS s(system_id))"""
# near documents by brute force: the sets of 5-character substrings of all texts against each other
NEAR_DOCS = f"""(WITH d AS (SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '{WS}', ' ', 'g'))) AS t FROM documents), c AS (SELECT t, min(doc_id) AS class FROM d GROUP BY t),
  s AS (SELECT class, unnest(CASE WHEN length(t) < 5 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 3), lambda i: substring(t, i, 5))) END) AS g FROM c WHERE t <> ''),
  n AS (SELECT class, count(*) AS n FROM s GROUP BY class)
  SELECT a, b, CAST(m AS DOUBLE) / (x.n + y.n - m) AS similarity FROM (SELECT p.class AS a, q.class AS b, count(*) AS m FROM s p JOIN s q ON p.g = q.g AND p.class < q.class GROUP BY 1, 2) JOIN n x ON x.class = a JOIN n y ON y.class = b
  WHERE m >= 0.85 * (x.n + y.n - m) - 1e-9)"""
DOC_CLASSES = f"(SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS class FROM (SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '{WS}', ' ', 'g'))) AS t FROM documents))"
TERM_RE = r"'(?i)\b' || regexp_escape(term_en) || '\b'"
FLAGGED = f"""(SELECT sample_id, system_id, topic,
    len(hw) > 0 AND (CASE WHEN len(w) > 0 THEN CAST(len(list_filter(w, lambda t: {_legal('t')})) AS DOUBLE) / len(w) ELSE 0 END) < 0.85 AS code_switching,
    (CASE WHEN len(rw) > 0 THEN CAST(len(hw) AS DOUBLE) / len(rw) ELSE 1 END) < 0.5 AS omission,
    len(pairs) <> len(list_distinct(pairs)) AS disfluency
  FROM (SELECT *, list_transform(list_zip(hw[:-2], hw[2:]), lambda p: p[1] || chr(1) || p[2]) AS pairs
        FROM (SELECT *, {_tokens('hypothesis')} AS hw, {_tokens('reference')} AS rw, {_words("coalesce(hypothesis, '')")} AS w FROM {ANSWERS})))"""
TEXT_FOLD = "lower(strip_accents(instruction))"
COHEN = """WITH cells AS (SELECT a, b, count(*) AS c FROM {pairs} WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b),
  t AS (SELECT sum(c) AS n, sum(c) FILTER (a = b) AS same FROM cells), ra AS (SELECT a AS label, sum(c) AS ra FROM cells GROUP BY a), cb AS (SELECT b AS label, sum(c) AS cb FROM cells GROUP BY b),
  x AS (SELECT CAST(n AS BIGINT) AS n, CAST(same AS DOUBLE) / n AS po, (SELECT sum(ra * cb) FROM ra JOIN cb USING (label)) / CAST(n AS DOUBLE) / n AS pe FROM t),
  k AS (SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected, round(CASE WHEN n < 2 THEN NULL WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM x)
  SELECT *, CASE WHEN kappa < 0 THEN 'poor' WHEN kappa < 0.2 THEN 'slight' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' WHEN kappa IS NOT NULL THEN 'almost perfect' END AS band FROM k"""
RANKS = f"""(SELECT *, low + (t - 1) / 2.0 AS r FROM (SELECT *, rank() OVER (PARTITION BY dimension, sample_id ORDER BY v) AS low, count(*) OVER (PARTITION BY dimension, sample_id, v) AS t
  FROM (SELECT *, count(*) OVER (PARTITION BY dimension, sample_id) AS here FROM (SELECT m.*, k FROM (SELECT dimension, sample_id, system_id, avg(value) AS v FROM {RATED} GROUP BY 1, 2, 3) m
  JOIN (SELECT dimension, count(DISTINCT system_id) AS k FROM {RATED} GROUP BY 1) USING (dimension))) WHERE here = k))"""


_FRIEDMAN = f"""SELECT dimension, blocks, systems, round(CASE WHEN blocks >= 3 AND systems >= 3 AND fix > 0 THEN raw / fix END, 4) AS chi2 FROM (SELECT dimension, n AS blocks, k AS systems, 12.0 / (n * k * (k + 1)) * ss - 3.0 * n * (k + 1) AS raw,
          1 - CAST(tied AS DOUBLE) / (n * k * (k * k - 1)) AS fix FROM (SELECT dimension, CAST(count(*) / max(k) AS BIGINT) AS n, max(k) AS k, sum(t * t - 1) AS tied FROM {RANKS} GROUP BY 1)
          JOIN (SELECT dimension, sum(rs * rs) AS ss FROM (SELECT dimension, system_id, sum(r) AS rs FROM {RANKS} GROUP BY 1, 2) GROUP BY 1) USING (dimension))"""


def oracle_sql() -> dict[str, str]:
    text_sum = "coalesce(answer_yo_final, '') || ' ' || coalesce(answer_en, '')"
    unsafe = f"regexp_matches({text_sum}, {_q(S.UNSAFE_PATTERN)})"
    clean = lambda c: f"nfc_normalize(trim(coalesce({c}, '')))"
    fold = "lower(strip_accents(question))"
    return {
        "q_composition": f"SELECT split, {TOPIC} AS topic, question_type, count(*) AS n FROM {FINAL} GROUP BY 1, 2, 3",
        "q_funnel": f"""WITH w AS (SELECT * FROM {WORK}) SELECT '1 records' AS stage, count(*) AS n FROM w UNION ALL SELECT '2 translated', count(*) FILTER ({_blank('answer_yo_mt')} IS NOT NULL) FROM w
          UNION ALL SELECT '3 edited', count(*) FILTER ({_blank('answer_yo_final')} IS NOT NULL AND {_blank('question_yo_final')} IS NOT NULL) FROM w UNION ALL SELECT '4 language checked', count(*) FILTER (validated_ling) FROM w
          UNION ALL SELECT '5 content checked', count(*) FILTER (validated_clin) FROM w UNION ALL SELECT '6 both', count(*) FILTER (validated_ling AND validated_clin) FROM w""",
        "q_provenance": f"SELECT doc_id, sha256(text) AS sha256, length(text) = n_chars AS length_agrees, {_blank('licence')} IS NOT NULL AS licensed FROM documents",
        "q_topic_names": f"SELECT coalesce(name, t, 'unknown') AS name, count(*) AS n FROM (SELECT lower(trim(topic)) AS t FROM {FINAL}) LEFT JOIN {_names()} ON names.topic = t GROUP BY 1",
        "q_next_id": "SELECT coalesce(max(CAST(nullif(regexp_extract(id, '([0-9]+)$', 1), '') AS BIGINT)), 0) + 1 AS next_id FROM working_record",
        "q_running_ids": "SELECT doc_id, printf('rec-%06d', row_number() OVER (ORDER BY url ASC NULLS FIRST, doc_id)) AS id FROM documents",
        "q_keep_first": f"SELECT id, epoch_us(received_at) AS received, validated_ling, validated_clin FROM {EARLY}",
        "q_keep_last": f"SELECT id, epoch_us(received_at) AS received, validated_ling, validated_clin FROM {WORK}",
        "q_update_merge": f"""SELECT id, validation_notes, ({clean('q')} <> {clean('question_yo_mt')}) OR ({clean('a')} <> {clean('answer_yo_mt')}) AS post_edited FROM (
          SELECT b.id, coalesce(nullif(e.validation_notes, ''), b.validation_notes) AS validation_notes, coalesce(nullif(e.question_yo_final, ''), b.question_yo_final) AS q, coalesce(nullif(e.answer_yo_final, ''), b.answer_yo_final) AS a,
          b.question_yo_mt, b.answer_yo_mt FROM {EARLY} b LEFT JOIN {WORK} e USING (id))""",
        "q_validation_route": _ROUTE,
        "q_discard_rate": f"SELECT question_type, count(*) AS n, count(*) FILTER (verdict = 'fail') AS failed, round(avg(CASE WHEN verdict = 'fail' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM ({_ROUTE}) GROUP BY 1",
        "q_merge_checked": f"""SELECT coalesce(a.id, b.id) AS id, coalesce(a.source_name, b.source_name) AS source_name, a.id IS NOT NULL AS validated_clin, b.id IS NOT NULL AS validated_ling
          FROM (SELECT id, source_name FROM {WORK} WHERE validated_clin) a FULL JOIN (SELECT id, source_name FROM {WORK} WHERE validated_ling) b ON a.id = b.id""",
        "q_elicited_join": f"""WITH w AS (SELECT * FROM {WORK}), c AS (SELECT DISTINCT ON (claim_id) claim_id, topic, answer_en FROM w WHERE question_type = 'derived' ORDER BY claim_id, id)
          SELECT n, coalesce(c.claim_id, printf('elicited-unmatched-%06d', n)) AS claim_id, CASE WHEN c.claim_id IS NULL THEN 'unclassified' ELSE c.topic END AS topic, CASE WHEN c.claim_id IS NULL THEN 'out_of_scope' ELSE 'elicited' END AS question_type,
          coalesce(length(answer_en), 0) AS answer_length FROM (SELECT CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) AS n, claim_id AS m FROM w WHERE question_type = 'elicited') LEFT JOIN c ON c.claim_id = m""",
        "q_cache_antijoin": "SELECT DISTINCT sha256(source_en) AS text_hash FROM final_record WHERE source_en <> '' AND source_en NOT IN (SELECT answer_en FROM working_record WHERE answer_en IS NOT NULL)",
        "q_cached_backend": f"""WITH f AS (SELECT id, output, split FROM {FINAL}) SELECT id, CASE WHEN coalesce(output, '') = '' THEN 0 WHEN held THEN 5 + length(output) ELSE length(upper(output)) END AS length, held AS cached
          FROM (SELECT *, coalesce(output, '') <> '' AND output IN (SELECT output FROM f WHERE split = 'val' AND output <> '') AS held FROM f)""",
        "q_missing_ids": "SELECT DISTINCT id FROM final_record WHERE split <> 'train' AND id NOT IN (SELECT sample_id FROM unblinded_rating WHERE sample_id IS NOT NULL)",
        "q_postedit_rows": f"""SELECT id, topic, coalesce(nullif(question_yo_final, ''), question_yo_mt, '') AS question, concat_ws(' ', nullif(question_yo_mt, ''), nullif(answer_yo_mt, '')) AS draft
          FROM {WORK} WHERE coalesce(nullif(question_yo_mt, ''), nullif(answer_yo_mt, '')) IS NOT NULL""",
        "q_promotion": f"SELECT CASE WHEN {_blank('answer_yo_final')} IS NOT NULL THEN 'reviewed' WHEN {_blank('answer_yo_mt')} IS NOT NULL THEN 'promoted' ELSE 'skipped' END AS route, count(*) AS n FROM {WORK} GROUP BY 1",
        "q_record_problems": f"""SELECT problem, count(*) AS n FROM (SELECT unnest([CASE WHEN {_blank('id')} IS NULL THEN 'id missing' END, CASE WHEN {_blank('claim_id')} IS NULL THEN 'claim_id missing' END, CASE WHEN {_blank('instruction')} IS NULL THEN 'instruction missing' END,
          CASE WHEN {_blank('output')} IS NULL THEN 'output missing' END, CASE WHEN question_type NOT IN ('derived', 'elicited', 'out_of_scope') THEN 'question_type unknown' END,
          CASE WHEN topic IS NULL OR topic NOT IN ({', '.join(map(_q, S.TOPICS))}) THEN 'topic unknown' END, CASE WHEN validated_ling IS NULL THEN 'validated_ling missing' END, CASE WHEN validated_clin IS NULL THEN 'validated_clin missing' END,
          CASE WHEN instruction IS NOT NULL AND instruction_nodia IS DISTINCT FROM strip_accents(instruction) THEN 'instruction_nodia out of sync' END,
          CASE WHEN nfc_normalize(instruction) <> instruction THEN 'instruction not composed' END, CASE WHEN nfc_normalize(output) <> output THEN 'output not composed' END,
          CASE WHEN {_foreign('instruction')} THEN 'instruction not Yoruba' END, CASE WHEN {_foreign('output')} THEN 'output not Yoruba' END]) AS problem FROM {FINAL}) WHERE problem IS NOT NULL GROUP BY 1""",
        "q_edit_problems": f"""SELECT problem, count(*) AS n FROM (SELECT unnest([CASE WHEN q = '' THEN 'question_yo_final missing' END, CASE WHEN a = '' THEN 'answer_yo_final missing' END, CASE WHEN coalesce({_blank('id')}, '') = '' THEN 'id missing' END,
          CASE WHEN {_foreign('q')} THEN 'question_yo_final not Yoruba' END, CASE WHEN {_foreign('a')} THEN 'answer_yo_final not Yoruba' END]) AS problem
          FROM (SELECT id, coalesce({_blank('question_yo_final')}, '') AS q, coalesce({_blank('answer_yo_final')}, '') AS a FROM {WORK} WHERE post_edited)) WHERE problem IS NOT NULL GROUP BY 1""",
        "q_rating_problems": "SELECT problem, count(*) AS n FROM (SELECT unnest(["
        + ", ".join(f"CASE WHEN ratings[{_q(x)}] IS NULL OR ratings[{_q(x)}] NOT BETWEEN 1 AND 5 THEN {_q(x + ' out of range')} END" for x in S.DIMENSIONS)
        + ", CASE WHEN harm IS NULL OR harm NOT IN ('None', 'Low', 'Moderate', 'Severe') THEN 'harm unknown' END]) AS problem FROM unblinded_rating) WHERE problem IS NOT NULL GROUP BY 1",
        "q_strip_diacritics": f"SELECT id, strip_accents(instruction) AS plain FROM {FINAL}",
        "q_charset": f"SELECT id, {_legal('nfc_normalize(answer_yo_mt)')} AS legal FROM {WORK} WHERE answer_yo_mt IS NOT NULL",
        "q_language_consistency": f"""SELECT split, tokens, legal, CASE WHEN tokens > 0 THEN round(CAST(legal AS DOUBLE) / tokens, 6) ELSE 0.0 END AS consistency FROM (SELECT split, CAST(coalesce(sum(len(w)), 0) AS BIGINT) AS tokens,
          CAST(coalesce(sum(len(list_filter(w, lambda t: {_legal('t')}))), 0) AS BIGINT) AS legal FROM (SELECT split, {_words('output')} AS w FROM {FINAL}) GROUP BY 1)""",
        "q_sentences": f"SELECT doc_id, len(string_split(regexp_replace(text, '([.!?]){WS}([A-Z0-9])', '\\1' || chr(30) || '\\2', 'g'), chr(30))) AS sentences FROM documents WHERE text IS NOT NULL",
        "q_boilerplate": f"SELECT doc_id, count(*) FILTER (regexp_matches(regexp_replace(line, '^{WS}|{WS}$', '', 'g'), {_q(_boiler())})) AS boilerplate, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY 1",
        "q_claims": _claims(),
        "q_classify": f"""SELECT id, coalesce(kind, 'none') AS category, replace({_question()}, '{{topic}}', name) AS question FROM (SELECT *, {_classify()} AS kind FROM (SELECT w.id, lower(answer_en) AS low, coalesce(names.name, lower(trim(w.topic))) AS name
          FROM {WORK} w LEFT JOIN {_names()} ON names.topic = lower(trim(w.topic))))""",
        "q_safety": f"""SELECT id, unsafe, CASE WHEN unsafe THEN 'out_of_scope' ELSE question_type END AS question_type, CASE WHEN unsafe THEN regexp_replace(coalesce(notes, '') || ' | rewritten as refusal', '^[ |]+|[ |]+$', '', 'g') ELSE notes END AS notes,
          CASE WHEN unsafe THEN TRUE ELSE answer_yo_final = {_q(S.REFUSAL)} END AS rewritten FROM (SELECT *, {unsafe} AS unsafe FROM {WORK})""",
        "q_term_frequency": f"""SELECT term, count(id) AS frequency FROM (SELECT DISTINCT term_en AS term, {TERM_RE} AS re FROM terminology WHERE term_en IS NOT NULL) LEFT JOIN {WORK} w ON regexp_matches(w.answer_en, re) GROUP BY 1""",
        "q_term_flags": f"""WITH w AS (SELECT * FROM (SELECT id, answer_en, concat_ws(' ', nullif(coalesce(nullif(question_yo_final, ''), question_yo_mt, ''), ''), nullif(coalesce(nullif(answer_yo_final, ''), answer_yo_mt, ''), '')) AS own FROM {WORK}) WHERE {_blank('own')} IS NOT NULL)
          SELECT DISTINCT id, term_en AS term, lower(trim(canonical_yo)) AS expected FROM terminology JOIN w ON regexp_matches(w.answer_en, {TERM_RE}) AND NOT contains(lower(strip_accents(own)), lower(strip_accents(lower(trim(canonical_yo)))))
          WHERE trim(coalesce(canonical_yo, '')) <> ''""",
        "q_topic_weights": f"""SELECT word, count(*) AS topics, round(ln(((SELECT count(DISTINCT {TOPIC}) FROM final_record) + 1.0) / (count(*) + 1)) + 1, 6) AS idf FROM (
          SELECT DISTINCT t, unnest({_tokens("replace(low, '?', '')")}) AS word FROM (SELECT {TOPIC} AS t, {TEXT_FOLD} AS low FROM {FINAL})) WHERE word NOT IN ({', '.join(map(_q, STOPWORDS))}) GROUP BY 1""",
        "q_fertility": f"""SELECT side, tokens, words, round(CAST(tokens AS DOUBLE) / words, 4) AS fertility FROM (SELECT side, CAST(sum(ceil(length(word) / 4.0)) AS BIGINT) AS tokens, count(*) AS words FROM (
          SELECT 'en' AS side, unnest({_tokens('answer_en')}) AS word FROM {WORK} UNION ALL SELECT 'yo', unnest({_tokens('answer_yo_final')}) FROM {WORK}) GROUP BY 1)""",
        "q_near_pairs": f"SELECT a AS doc_a, b AS doc_b, round(similarity, 6) AS similarity FROM {NEAR_DOCS} UNION ALL SELECT class, doc_id, 1.0::DOUBLE FROM {DOC_CLASSES} WHERE t <> '' AND class <> doc_id",
        "q_near_classes": f"""WITH l AS (SELECT * FROM {NEAR_DOCS}) SELECT doc_id, class, coalesce(links, 0) AS links FROM {DOC_CLASSES} LEFT JOIN (SELECT class, count(*) AS links FROM (SELECT a AS class FROM l UNION ALL SELECT b FROM l) GROUP BY 1) USING (class)""",
        "q_deduplicated": f"SELECT doc_id FROM {DOC_CLASSES} WHERE class = doc_id AND doc_id NOT IN (SELECT b FROM {NEAR_DOCS})",
        "q_stratified_sample": _sampled(FINAL, "0.1"),
        "q_sample_at_least": f"WITH t AS (SELECT * FROM {FINAL} WHERE split <> 'train') SELECT id FROM ({_sampled('t', '(150.0 / (SELECT count(*) FROM t))')}) WHERE (SELECT count(*) FROM t) > 150 UNION ALL SELECT id FROM t WHERE (SELECT count(*) FROM t) <= 150",
        "q_fixed_per_topic": f"SELECT id, topic FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY {_hash('id')}, id) AS r FROM {FINAL}) WHERE r <= 5",
        "q_double_annotation": f"""WITH w AS (SELECT id, topic FROM {WORK} WHERE answer_yo_final IS NOT NULL) SELECT id, topic, 1 AS annotator_slot FROM w UNION ALL
          SELECT id, topic, 2 FROM (SELECT *, row_number() OVER (ORDER BY {_hash('id')}, id) AS r, count(*) OVER () AS n FROM w) WHERE r <= round_even(n * 0.1, 0)""",
        "q_group_split": f"SELECT * FROM {OWN_SPLIT}",
        "q_torn_groups": f"SELECT claim_id, count(DISTINCT split) AS splits FROM {KEYED} GROUP BY 1 HAVING count(DISTINCT split) > 1",
        "q_own_split": f"SELECT split, splits, count(*) AS records, count(DISTINCT claim_id) AS claims FROM (SELECT k.id, s.*, 1::BIGINT AS splits FROM {KEYED} k JOIN {OWN_SPLIT} s USING (claim_id)) GROUP BY 1, 2",
        "q_blinding": f"SELECT * FROM {BLINDED}",
        "q_blinded_items": f"SELECT b.sample_id, slot, length(h) AS characters FROM {BLINDED} b LEFT JOIN (SELECT sample_id, system_id, min(response_yo) AS h FROM unblinded_rating GROUP BY 1, 2) r ON r.sample_id = b.sample_id AND r.system_id = b.system_id",
        "q_rater_sheets": f"SELECT CAST(rater AS INTEGER) AS rater, row_number() OVER (PARTITION BY rater ORDER BY md5((rater + {S.SEED}) || '|' || sample_id || '|' || slot), sample_id, slot) AS position, sample_id, slot FROM {BLINDED}, range(1, 4) AS r(rater)",
        "q_unblinded": "SELECT system_id, count(*) AS n FROM unblinded_rating WHERE sample_id IS NOT NULL AND system_id IS NOT NULL GROUP BY 1",
        "q_corpus_mix": _MIX,
        "q_mean_ratings": f"SELECT system_id, dimension, count(*) AS n, round(avg(value), 3) AS mean FROM {RATED} GROUP BY 1, 2",
        "q_harm_distribution": f"SELECT system_id, count(*) FILTER (harm = 'None') AS none, count(*) FILTER (harm = 'Low') AS low, count(*) FILTER (harm = 'Moderate') AS moderate, count(*) FILTER (harm = 'Severe') AS severe FROM {JUDGED} GROUP BY 1",
        "q_harm_incidents": f"SELECT sample_id, system_id, rater_id, harm, comment FROM {JUDGED} WHERE harm IN ('Moderate', 'Severe')",
        "q_complete_items": f"SELECT sample_id FROM {JUDGED} GROUP BY 1 HAVING count(DISTINCT system_id) = (SELECT count(DISTINCT system_id) FROM unblinded_rating)",
        "q_cohen": COHEN.format(pairs=f"(SELECT arg_min(harm, rater_id) AS a, arg_max(harm, rater_id) AS b FROM {JUDGED} WHERE harm IS NOT NULL GROUP BY sample_id, system_id HAVING count(*) > 1)"),
        "q_double_kappa": COHEN.format(pairs=f"""(SELECT max(v) FILTER (slot = 1) AS a, max(v) FILTER (slot = 2) AS b FROM (SELECT sample_id, system_id, CASE WHEN harm IN ('Moderate', 'Severe') THEN 'fail' ELSE 'pass' END AS v,
          row_number() OVER (PARTITION BY sample_id, system_id ORDER BY rater_id) AS slot FROM {JUDGED} WHERE harm IS NOT NULL) GROUP BY sample_id, system_id)"""),
        "q_fleiss": f"""WITH n AS (SELECT sample_id, system_id, harm, count(*) AS c FROM {JUDGED} WHERE harm IS NOT NULL GROUP BY 1, 2, 3), per AS (SELECT sample_id, system_id, CAST(sum(c) AS BIGINT) AS m, sum(c * c) AS q FROM n GROUP BY 1, 2 HAVING sum(c) > 1),
          shares AS (SELECT m, sum(c * c) / CAST(sum(c) AS DOUBLE) / sum(c) AS pe FROM (SELECT m, harm, sum(c) AS c FROM n JOIN per USING (sample_id, system_id) GROUP BY 1, 2) GROUP BY m),
          x AS (SELECT m, count(*) AS items, avg((q - m) / CAST(m * (m - 1) AS DOUBLE)) AS po FROM per GROUP BY m)
          SELECT m AS raters, items, round(po, 6) AS observed, round(pe, 6) AS expected, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM x JOIN shares USING (m)""",
        "q_krippendorff": f"""WITH r AS (SELECT * FROM {RATED}), s AS (SELECT dimension, sample_id, system_id, count(*) AS m FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1), n AS (SELECT r.*, m FROM r JOIN s USING (dimension, sample_id, system_id)),
          nv AS (SELECT dimension, value, count(*) AS nv FROM n GROUP BY 1, 2), mid AS (SELECT *, sum(nv) OVER (PARTITION BY dimension ORDER BY value) - nv / 2.0 AS mid, sum(nv) OVER (PARTITION BY dimension) AS total FROM nv),
          seen AS (SELECT a.dimension, sum((ma.mid - mb.mid) * (ma.mid - mb.mid) / (a.m - 1)) AS apart FROM n a JOIN n b ON a.dimension = b.dimension AND a.sample_id = b.sample_id AND a.system_id = b.system_id AND a.rater_id <> b.rater_id
            JOIN mid ma ON ma.dimension = a.dimension AND ma.value = a.value JOIN mid mb ON mb.dimension = b.dimension AND mb.value = b.value GROUP BY 1),
          ex AS (SELECT x.dimension, sum(x.nv * CAST(y.nv AS DOUBLE) * (x.mid - y.mid) * (x.mid - y.mid)) / (any_value(x.total) - 1) AS e FROM mid x JOIN mid y USING (dimension) GROUP BY 1), items AS (SELECT dimension, count(*) AS items FROM s GROUP BY 1)
          SELECT dimension, items, round(CASE WHEN e = 0 THEN 1 ELSE 1 - apart / e END, 6) AS alpha FROM items JOIN seen USING (dimension) JOIN ex USING (dimension)""",
        "q_friedman_p": "SELECT dimension, blocks, systems, chi2, CASE WHEN systems % 2 = 1 THEN round(exp(-chi2 / 2) * list_sum(list_transform(range((systems - 1) // 2), lambda i: pow(chi2 / 2, i) / factorial(CAST(i AS INTEGER)))), 6) END AS p_value FROM (" + _FRIEDMAN + ")",  # the tail in closed form for an even number of degrees of freedom
        "q_friedman": _FRIEDMAN,
        "q_paired_points": f"""WITH a AS (SELECT *, CAST(len({_tokens('hypothesis')}) AS DOUBLE) AS score FROM {ANSWERS}), p AS (SELECT a.system_id, a.score, m.score AS m FROM a JOIN a m ON m.system_id = 'M' AND m.sample_id = a.sample_id WHERE a.system_id <> 'M')
          SELECT system_id, count(*) AS n, round(avg(score), 6) AS mean_a, round(avg(m), 6) AS mean_b, round(avg(m - score), 6) AS diff, round(CASE WHEN stddev_samp(m - score) > 0 THEN avg(m - score) / stddev_samp(m - score) ELSE 0 END, 6) AS effect FROM p GROUP BY 1""",
        "q_worst": f"SELECT sample_id, system_id, round(CAST(len({_tokens('hypothesis')}) AS DOUBLE) / greatest(len({_tokens('reference')}), 1), 6) AS ratio FROM {ANSWERS} ORDER BY ratio ASC NULLS LAST, sample_id, system_id LIMIT 50",
        "q_surface_flags": f"SELECT sample_id, system_id, code_switching, omission, disfluency FROM {FLAGGED}",
        "q_surface_counts": f"SELECT topic, error, count(*) AS n FROM (UNPIVOT (SELECT topic, code_switching, omission, disfluency FROM {FLAGGED}) ON code_switching, omission, disfluency INTO NAME error VALUE flag) WHERE flag GROUP BY 1, 2",
        "q_surface_pivot": f"SELECT topic, count(*) FILTER (code_switching) AS code_switching, count(*) FILTER (omission) AS omission, count(*) FILTER (disfluency) AS disfluency FROM {FLAGGED} GROUP BY 1",
        "q_guardrails": f"""SELECT outcome, count(*) AS n, CAST(sum(CASE outcome WHEN 'out_of_scope' THEN {len(S.RULES.out_of_scope_text)} WHEN 'clinical_boundary' THEN {len(S.RULES.boundary_text)} WHEN 'answered' THEN {3 + len(S.RULES.disclaimer)} ELSE 0 END) AS BIGINT) AS characters
          FROM (SELECT CASE WHEN {_blank('question')} IS NULL THEN 'blank' WHEN NOT {_hit('f', S.RULES.scope)} THEN 'out_of_scope' WHEN {_hit('f', S.RULES.boundary)} THEN 'clinical_boundary' ELSE 'answered' END AS outcome
          FROM (SELECT question, {fold} AS f FROM (SELECT coalesce(question_yo_mt, '') AS question FROM {WORK}))) GROUP BY 1""",
        "q_confirmed_errors": f"""SELECT topic, error, count(*) AS n FROM (SELECT coalesce(lower(trim(topic)), 'unclassified') AS topic, lower(harm) AS error FROM {JUDGED} WHERE harm IN ('Severe', 'Moderate', 'Low')) GROUP BY 1, 2""",
        "q_document_topics": f"""SELECT printf('rec-%06d', row_number() OVER (ORDER BY url ASC NULLS FIRST, doc_id)) AS id, doc_id, topic, coalesce(source, 'unknown') || ' (' || slug || '), retrieved ' || retrieval_date || ', licence: ' || licence AS source_ref
          FROM (SELECT *, regexp_extract(url, '^https?://[^/]+/([^/]+)', 1) AS slug FROM documents) JOIN (VALUES {', '.join(f'({_q(k)}, {_q(v)})' for k, v in S.SLUG_TOPICS.items())}) AS t(slug, topic) USING (slug)""",
        "q_questions": f"""SELECT id, CASE WHEN good THEN trim(question_en) ELSE replace({_question()}, '{{topic}}', name) END AS question, CASE WHEN good THEN 'model' ELSE 'template_fallback' END AS backend_used FROM (SELECT *, {_classify()} AS kind,
          coalesce(question_type = 'elicited' AND trim(question_en) LIKE '%?', FALSE) AS good FROM (SELECT w.id, w.question_en, w.question_type, lower(answer_en) AS low, coalesce(names.name, lower(trim(w.topic))) AS name FROM {WORK} w LEFT JOIN {_names()} ON names.topic = lower(trim(w.topic))))""",
        "q_release": f"""SELECT id, claim_id, question_yo_final AS instruction, strip_accents(question_yo_final) AS instruction_nodia, '' AS input, answer_yo_final AS output, coalesce(topic, 'unclassified') AS topic, coalesce(question_type, 'derived') AS question_type,
          coalesce(answer_en, '') AS source_en, coalesce(source_ref, '') AS source_ref, coalesce(validated_ling, FALSE) AS validated_ling, coalesce(validated_clin, FALSE) AS validated_clin FROM {WORK} WHERE {_blank('question_yo_final')} IS NOT NULL AND {_blank('answer_yo_final')} IS NOT NULL""",
        "q_topic_count": f"SELECT count(DISTINCT lower(trim(topic))) AS n_topics, (SELECT count(DISTINCT claim_id) FROM {KEYED}) AS n_claims FROM {FINAL}",
        "q_common_terms": f"""SELECT CAST(row_number() OVER (ORDER BY frequency DESC, term) AS INTEGER) AS rank, term, frequency FROM (SELECT term, count(id) AS frequency FROM (SELECT DISTINCT term_en AS term, {TERM_RE} AS re FROM terminology WHERE term_en IS NOT NULL) JOIN {WORK} w ON regexp_matches(w.answer_en, re) GROUP BY 1)""",
        "q_systems": f"""SELECT CAST(row_number() OVER (ORDER BY characters DESC NULLS LAST, n) AS INTEGER) AS place, * FROM (SELECT system_id, skip_reason, count(*) AS n, CAST(coalesce(sum(length(answer)), 0) AS BIGINT) AS characters
          FROM (SELECT 'echo' AS system_id, CASE WHEN length(instruction) > 60 THEN instruction END AS answer, CASE WHEN length(instruction) > 60 THEN NULL ELSE 'no answer' END AS skip_reason FROM {FINAL} WHERE split = 'test'
          UNION ALL SELECT 'short', substr(instruction, 1, 20), NULL FROM {FINAL} WHERE split = 'test' UNION ALL SELECT 'absent', NULL, 'not installed' FROM {FINAL} WHERE split = 'test') GROUP BY 1, 2)""",
        "q_masked_labels": f"SELECT id, least(length(instruction), greatest(length(output), 1)) AS masked FROM {FINAL} WHERE output IS NOT NULL",
        "q_few_shot": f"""WITH f AS (SELECT * FROM {FINAL}), s AS (SELECT string_agg('Q: ' || instruction || chr(10) || 'A: ' || output, chr(10) || chr(10) ORDER BY id) AS t FROM (SELECT * FROM f WHERE split = 'train' AND output IS NOT NULL ORDER BY id LIMIT 3))
          SELECT id, length('Answer in Yoruba.' || chr(10) || chr(10) || t || chr(10) || chr(10) || 'Q: ' || instruction || chr(10) || 'A:') AS prompt_length FROM f, s WHERE split = 'test'""",
        "q_interactions": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1",
        "q_windows": _WINDOWS,
        "q_stream_windows": _WINDOWS,
        "q_sessions": """SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 1800000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
        "q_jsonl_round_trip": f"SELECT split, count(*) AS n, count(*) FILTER (output IS NULL) AS no_output FROM {FINAL} GROUP BY 1",
        "q_rel_pricing": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
        "q_rel_rollup": "SELECT n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)",
        "q_rel_top_orders": "SELECT c_mktsegment, CAST(rank AS INTEGER) AS rank, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rank <= 3",
    }


def _boiler() -> str:
    from cowrie.operators.segment import BOILERPLATE_PATTERN

    return BOILERPLATE_PATTERN


def _claims() -> str:
    boiler, strip = _q(_boiler()), lambda c: f"regexp_replace({c}, '^{WS}|{WS}$', '', 'g')"
    ends = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
    quote = "'^[\\p{Lu}\\p{Nd}\"''“(]'"
    return rf"""WITH l AS (SELECT doc_id, source, list_transform(list_transform(string_split_regex(text, {ends}), lambda x: {strip('x')}), lambda x: {{'s': x, 'p': x <> '' AND NOT regexp_matches(x, {boiler})}}) AS ls FROM documents WHERE text IS NOT NULL),
      z AS (SELECT doc_id, source, list_zip(list_concat([{{'s': '', 'p': FALSE}}], ls[:len(ls) - 1]), ls) AS zs FROM l),
      m AS (SELECT doc_id, source, list_filter(string_split(array_to_string(list_transform(zs, lambda z: CASE WHEN z[2].p AND z[1].p AND NOT regexp_matches(z[1].s, '[.!?:]$') AND regexp_matches(z[2].s, '^[\p{{Ll}},;)]') THEN ' ' ELSE chr(1) END || z[2].s), ''), chr(1)), lambda x: x <> '' AND NOT regexp_matches(x, {boiler})) AS ms FROM z),
      c AS (SELECT doc_id, source, list_filter(list_transform(flatten(list_transform(ms, lambda x: string_split(regexp_replace(x, '([.!?]){WS}([A-Z0-9])', '\1' || chr(30) || '\2', 'g'), chr(30)))), lambda x: {strip('x')}),
        lambda x: length(x) BETWEEN 25 AND 400 AND NOT regexp_matches(x, {boiler}) AND regexp_matches(x, '[.!]$') AND NOT regexp_matches(x, '(?s)^\(.*\)$') AND len(string_split_regex(x, '{WS}')) >= 5 AND regexp_matches(x, {quote})) AS cs FROM m)
      SELECT doc_id, source, position, claim, printf('%s-%s-%03d', coalesce(source, 'unknown'), CAST(doc_id AS VARCHAR), position) AS claim_id FROM (SELECT doc_id, source, CAST(unnest(range(len(cs))) AS INTEGER) AS position, unnest(cs) AS claim FROM c)"""


_ROUTE = f"""SELECT id, verdict, question_type, regexp_replace(coalesce(validation_notes, '') || ' | verdict ' || verdict, '^[ |]+|[ |]+$', '', 'g') AS note
  FROM (SELECT *, CASE WHEN validated_clin AND validated_ling THEN 'pass' ELSE 'fail' END AS verdict FROM {WORK} WHERE question_yo_final IS NOT NULL)"""
_WINDOWS = "SELECT CAST(epoch_us(ts) // 86400000000 * 86400 AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
_MIX = """WITH d AS (SELECT doc_id, CASE lower(trim(lang)) WHEN 'yo' THEN 'own' WHEN 'en' THEN 'other' END AS side FROM documents WHERE text IS NOT NULL),
  c AS (SELECT count(*) FILTER (side = 'own') AS a, count(*) FILTER (side = 'other') AS b FROM d), t AS (SELECT least(a / 0.7::DOUBLE, b / (1 - 0.7::DOUBLE)) AS total FROM c)
  SELECT doc_id, side FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY md5('42|' || doc_id), doc_id) AS r FROM d WHERE side IS NOT NULL), t
  WHERE r <= round_even(total * CASE side WHEN 'own' THEN 0.7::DOUBLE ELSE 1 - 0.7::DOUBLE END, 0)"""
