"""The same rows as SQL, written from the definitions and not from the operators: reversed text is really reversed, counts
are window counts or plain groups, positions are list positions."""

from __future__ import annotations

A, L3, L2, L1 = "0.1", "0.6", "0.3", "0.1"
_CLASS = r"[0-9A-Za-z\x{0400}-\x{052F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}]+"


def _normalized(column: str) -> str:
    x = column
    for pattern, new in (
        (r"[\x{00A0}\x{00AD}\x{200B}\x{FEFF}]", " "), ("<[^>]+>", " "), (r"(?i)\b\d+[:.]\d+[a-z]?\b", " "), (r"[\x{0387}\x{2058}\x{00B7};:]", " . "),
        (r"[|\x{2014}\x{2013}\x{2011}]", " "), (r"[\x{201C}\x{201D}\x{00AB}\x{00BB}]", '"'), (r"[\t ]+", " "),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _uniform(*parts: str) -> str:
    return f"((('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 8))::BIGINT) / 4294967296.0)"


def _draw(seed: int, purpose: str) -> str:
    return _uniform(f"'{seed}'", f"'{purpose}'", "doc_id::VARCHAR", "sent_pos::VARCHAR")


SENT = rf"""
parts AS (SELECT doc_id, i - 1 AS sent_pos, p[i] AS part FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i
          FROM (SELECT doc_id, string_split_regex({_normalized("text")}, '[\n.!?]+') AS p FROM documents))),
sent AS MATERIALIZED (SELECT * FROM (SELECT doc_id, sent_pos::INTEGER AS sent_pos,
          list_filter(list_transform(regexp_extract_all(part, '{_CLASS}'), lambda t: lower(regexp_replace(t, '[\x{{0483}}-\x{{0486}}\x{{0488}}\x{{0489}}]', '', 'g'))),
                      lambda t: t <> '' AND NOT regexp_matches(t, '[0-9]')) AS tokens FROM parts) WHERE len(tokens) BETWEEN 6 AND 80)"""


def _lm(sent: str = "sent", p: str = "") -> str:
    """Count tables u, b, t and the scalars of a corpus."""
    return f"""
{p}pad AS (SELECT list_concat(['<s>', '<s>'], tokens, ['</s>']) AS t FROM {sent}),
{p}g AS (SELECT t[i] AS w, t[i - 1] AS w1, t[i - 2] AS w2, i FROM (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM {p}pad)),
{p}u AS MATERIALIZED (SELECT w, count(*) AS c FROM {p}g GROUP BY 1),
{p}b AS MATERIALIZED (SELECT w1, w, count(*) AS c FROM {p}g WHERE i >= 2 GROUP BY 1, 2),
{p}t AS MATERIALIZED (SELECT w2, w1, w, count(*) AS c FROM {p}g WHERE i >= 3 GROUP BY 1, 2, 3),
{p}st AS MATERIALIZED (SELECT sum(c)::BIGINT AS n_total, count(*) AS v_size, sum(c) FILTER (WHERE w = '</s>')::BIGINT AS n_sent FROM {p}u)"""


_N, _V = "(SELECT n_total FROM st)", "(SELECT v_size FROM st)"


def _p(t: str, b2: str, b1: str, u1: str, u: str) -> str:
    return f"({L3} * (coalesce({t}, 0) + {A}) / (coalesce({b2}, 0) + {A} * {_V}) + {L2} * (coalesce({b1}, 0) + {A}) / (coalesce({u1}, 0) + {A} * {_V}) + {L1} * (coalesce({u}, 0) + {A}) / ({_N} + {A} * {_V}))"


def _surprisal(name: str, tokens: str, idx: str) -> str:
    return f"""
{name}0 AS (SELECT doc_id, sent_pos, len(t) AS n, i, t[i] AS w, t[i - 1] AS w1, t[i - 2] AS w2 FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i
            FROM (SELECT doc_id, sent_pos, list_concat(['<s>', '<s>'], {tokens}, ['</s>']) AS t FROM sent))),
{name}1 AS (SELECT *, count(*) OVER (PARTITION BY w) AS cu, count(*) FILTER (WHERE i >= 2) OVER (PARTITION BY w1, w) AS cb, count(*) FILTER (WHERE i >= 3) OVER (PARTITION BY w2, w1, w) AS ct,
                   count(*) FILTER (WHERE i >= 3) OVER (PARTITION BY w2, w1) AS cc, count(*) FILTER (WHERE i >= 2) OVER (PARTITION BY w1) AS c1 FROM {name}0),
{name} AS MATERIALIZED (SELECT doc_id, sent_pos, ({idx})::BIGINT AS token_idx, w AS token, -ln({_p("ct", "cc", "cb", "c1", "cu")}) AS s FROM {name}1 WHERE i >= 3 AND i < n)"""


_FWD, _BWD = _surprisal("f", "tokens", "i - 3"), _surprisal("r", "list_reverse(tokens)", "n - 1 - i")
_GAPS = f"""
gap AS (SELECT doc_id, sent_pos, i - 1 AS gap_idx, tokens[i] AS l, tokens[i + 1] AS r FROM (SELECT *, unnest(range(1, len(tokens))) AS i FROM sent)),
gs AS MATERIALIZED (SELECT gap.*, round(0.5 * (-ln((coalesce(b.c, 0) + {A}) / (ul.c + {A} * {_V})) - ln((coalesce(b.c, 0) + {A}) / (ur.c + {A} * {_V}))), 6) + 0.0 AS gap_score
       FROM gap LEFT JOIN b ON b.w1 = l AND b.w = r LEFT JOIN u AS ul ON ul.w = l LEFT JOIN u AS ur ON ur.w = r)"""


def _corrupt(sent: str, u: str, seed: int) -> str:
    return f"""
vocab AS MATERIALIZED (SELECT w, row_number() OVER (ORDER BY w) - 1 AS vk, count(*) OVER () AS v FROM {u} WHERE w NOT IN ('<s>', '</s>')),
del AS (SELECT *, CASE WHEN len(tokens) >= 6 AND {_draw(seed, "delete")} < 0.04 THEN floor({_draw(seed, "delete_at")} * len(tokens))::INTEGER END AS d FROM {sent}),
kept AS (SELECT *, CASE WHEN d IS NULL THEN tokens ELSE list_concat(tokens[1:d], tokens[d + 2:]) END AS k FROM del),
pick AS (SELECT *, CASE WHEN len(tokens) >= 6 AND len(k) >= 3 AND {_draw(seed, "substitute")} < 0.12 THEN floor({_draw(seed, "substitute_at")} * len(k))::INTEGER END AS s,
                floor({_draw(seed, "word")} * (SELECT max(v) FROM vocab))::BIGINT AS r FROM kept),
cor AS MATERIALIZED (SELECT doc_id, sent_pos, tokens, d, s, CASE WHEN s IS NOT NULL THEN k[s + 1] END AS orig, CASE WHEN s IS NOT NULL THEN CASE WHEN a.w = k[s + 1] THEN z.w ELSE a.w END END AS new,
               CASE WHEN s IS NULL THEN k ELSE list_concat(k[1:s], [CASE WHEN a.w = k[s + 1] THEN z.w ELSE a.w END], k[s + 2:]) END AS tc,
               CASE WHEN d IS NOT NULL THEN tokens[d + 1] END AS dtok, CASE WHEN d > 0 THEN tokens[d] END AS dl, CASE WHEN d IS NOT NULL THEN tokens[d + 2] END AS dr
        FROM (SELECT doc_id, sent_pos, tokens, d, k, s, r FROM pick) AS x LEFT JOIN vocab AS a ON a.vk = x.r LEFT JOIN vocab AS z ON z.vk = (x.r + 1) % (SELECT max(v) FROM vocab)),
cg AS (SELECT doc_id, sent_pos, i - 1 AS gap_idx, tc[i] AS l, tc[i + 1] AS r FROM (SELECT doc_id, sent_pos, tc, unnest(range(1, len(tc))) AS i FROM cor)),
loc AS MATERIALIZED (SELECT cor.doc_id, cor.sent_pos, dtok, tc, (SELECT min(gap_idx) FROM cg WHERE cg.doc_id = cor.doc_id AND cg.sent_pos = cor.sent_pos AND cg.l = dl AND cg.r = dr) AS gap_idx FROM cor WHERE d IS NOT NULL)"""


_SCORED = """
scored AS (SELECT 'value' AS method, value AS score, (event_type = 'purchase')::INTEGER AS label, event_id FROM events WHERE value IS NOT NULL
           UNION ALL SELECT 'user_mod', (user_id % 17)::DOUBLE, (event_type = 'purchase')::INTEGER, event_id FROM events WHERE user_id IS NOT NULL)"""


def _curve(scored: str = "scored", p: str = "") -> str:
    return f"""
{p}pts AS (SELECT method, threshold, tp / n AS precision, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS recall FROM (
        SELECT method, threshold, sum(l) OVER w AS tp, sum(c) OVER w AS n, sum(l) OVER (PARTITION BY method) AS pos FROM
        (SELECT method, score AS threshold, sum(label)::DOUBLE AS l, count(*)::DOUBLE AS c FROM {scored} GROUP BY 1, 2) WINDOW w AS (PARTITION BY method ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))),
{p}curve AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY method ORDER BY threshold NULLS LAST) - 1 AS position FROM (
        SELECT * FROM {p}pts UNION ALL SELECT DISTINCT method, NULL::DOUBLE, 1.0, 0.0 FROM {p}pts)),
{p}ap AS (SELECT method, sum(precision * (recall - before)) AS average_precision FROM (SELECT *, coalesce(lag(recall) OVER (PARTITION BY method ORDER BY threshold DESC), 0) AS before FROM {p}pts) GROUP BY 1)"""


def _best(p: str = "", compat: bool = True) -> str:
    shift = lambda c: f"lead({c}) OVER (PARTITION BY method ORDER BY position)" if compat else c
    return f"""
{p}best AS (SELECT method, threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY f1 DESC, threshold) AS k FROM (
        SELECT method, threshold, round(2 * p * r / (p + r), 12) AS f1 FROM (SELECT method, threshold, {shift("precision")} AS p, {shift("recall")} AS r FROM {p}curve)
        WHERE threshold IS NOT NULL AND p + r > 0)) WHERE k = 1)"""


def _suggested(targets: str, limit: int = 5) -> str:
    """targets: place, l2, l1, r1, cur."""
    return f"""
cand AS MATERIALIZED (SELECT w FROM u WHERE w NOT IN ('<s>', '</s>') ORDER BY c DESC, w DESC LIMIT 3000),
sc AS (SELECT place, cand.w AS candidate, round(ln({_p("t1.c", "b1.c", "b2.c", "u1.c", "uc.c")}) + ln({_p("t2.c", "b2.c", "b3.c", "uc.c", "ur.c")}), 6) AS score
       FROM {targets} AS x CROSS JOIN cand
       LEFT JOIN t AS t1 ON t1.w2 = l2 AND t1.w1 = l1 AND t1.w = cand.w LEFT JOIN b AS b1 ON b1.w1 = l2 AND b1.w = l1 LEFT JOIN b AS b2 ON b2.w1 = l1 AND b2.w = cand.w
       LEFT JOIN u AS u1 ON u1.w = l1 LEFT JOIN u AS uc ON uc.w = cand.w LEFT JOIN t AS t2 ON t2.w2 = l1 AND t2.w1 = cand.w AND t2.w = r1
       LEFT JOIN b AS b3 ON b3.w1 = cand.w AND b3.w = r1 LEFT JOIN u AS ur ON ur.w = r1 WHERE cur IS NULL OR cur <> cand.w),
sug AS MATERIALIZED (SELECT * FROM (SELECT place, candidate, score, row_number() OVER (PARTITION BY place ORDER BY score DESC, candidate DESC) AS rank FROM sc) WHERE rank <= {limit})"""


def _around(tokens: str, i: str) -> str:
    """Context of the word at list position i (from 1): two before it, one after."""
    return f"CASE WHEN {i} > 2 THEN {tokens}[{i} - 2] ELSE '<s>' END AS l2, CASE WHEN {i} > 1 THEN {tokens}[{i} - 1] ELSE '<s>' END AS l1, coalesce({tokens}[{i} + 1], '</s>') AS r1, {tokens}[{i}] AS cur"


def _between(tokens: str, g: str) -> str:
    return f"CASE WHEN {g} >= 1 THEN {tokens}[{g}] ELSE '<s>' END AS l2, {tokens}[{g} + 1] AS l1, {tokens}[{g} + 2] AS r1, NULL::VARCHAR AS cur"


_TOP_TOKENS = f"""
top AS MATERIALIZED (SELECT row_number() OVER (ORDER BY round(s, 6) DESC, doc_id, sent_pos, token_idx) AS place, * FROM f ORDER BY 1 LIMIT 15),
tgt AS (SELECT place, {_around("tokens", "(token_idx + 1)")} FROM top JOIN sent USING (doc_id, sent_pos))"""
_TOP_GAPS = f"""
top AS MATERIALIZED (SELECT row_number() OVER (ORDER BY gap_score DESC, doc_id, sent_pos, gap_idx) AS place, * FROM gs ORDER BY 1 LIMIT 15),
tgt AS (SELECT place, {_between("tokens", "gap_idx")} FROM top JOIN sent USING (doc_id, sent_pos))"""
_SPLIT = f"""
split AS MATERIALIZED (SELECT *, {_draw(7, "split")} < 0.75 AS is_train FROM sent),
tr AS (SELECT * FROM split WHERE is_train), te AS (SELECT * FROM split WHERE NOT is_train)"""
_ALL = f"WITH {SENT}, {_lm()}"
_COR = f"{_ALL}, {_corrupt('sent', 'u', 8)}"
_LOG_FREQ = f"""{_ALL}, tl AS (SELECT doc_id, sent_pos, (i - 1)::INTEGER AS token_idx, round(ln(1 + c), 6) + 0.0 AS log_freq, length(tokens[i])::BIGINT AS char_len
FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM sent) JOIN u ON u.w = tokens[i])"""
_TOKEN_LABELS = f"""{_COR}, tl AS (SELECT doc_id, sent_pos, (i - 1)::INTEGER AS token_idx, coalesce(s = i - 1, FALSE)::INTEGER AS label
FROM (SELECT doc_id, sent_pos, s, unnest(range(1, len(tc) + 1)) AS i FROM cor))"""


def _prf(scored: str, thresholds: str) -> str:
    return f"""SELECT method, threshold, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS p, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS r FROM (
SELECT method, threshold, sum(label) FILTER (WHERE score >= threshold)::DOUBLE AS tp, count(*) FILTER (WHERE score >= threshold)::DOUBLE AS called, sum(label)::DOUBLE AS pos
FROM {scored} JOIN {thresholds} USING (method) GROUP BY 1, 2)"""


_F1 = "round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) + 0.0 AS f1"
_EMB = "SELECT vec_id, vec_id // 50 AS g, vec_id % 50 AS i, embedding::DOUBLE[] AS e FROM embeddings"
_COS = "list_inner_product({0}, {1}) / (sqrt(list_inner_product({0}, {0})) * sqrt(list_inner_product({1}, {1})))"

def _outliers(tokens: str, vectors: str) -> str:
    """tokens: doc_id, sent_pos, token_idx, token; vectors: w, e. The sum of the neighbours' vectors points where their mean does."""
    return f"""
ov AS MATERIALIZED (SELECT doc_id, sent_pos, token_idx, e FROM {tokens} LEFT JOIN {vectors} ON w = token),
ot AS MATERIALIZED (SELECT doc_id, sent_pos, token_idx, e, [{', '.join(f"coalesce(sum(e[{d}]) OVER w, 0)" for d in range(1, 9))}] AS s, count(e) OVER w AS n FROM ov
       WINDOW w AS (PARTITION BY doc_id, sent_pos ORDER BY token_idx RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING EXCLUDE CURRENT ROW)),
out AS MATERIALIZED (SELECT doc_id, sent_pos, token_idx, round(CASE WHEN e IS NULL THEN 1 WHEN n = 0 THEN 0 ELSE 1 - {_COS.format("e", "s")} END, 6) + 0.0 AS ft_outlier FROM ot)"""


_VECTORS = f"[{', '.join(_uniform(chr(39) + 'vector' + chr(39), repr(str(d)), 'w') + ' - 0.5' for d in range(8))}] AS e"
_TOKENS = "tok AS MATERIALIZED (SELECT doc_id, sent_pos, (i - 1)::INTEGER AS token_idx, tokens[i] AS token FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM sent))"

ORACLES: dict[str, str] = {
    "token_outliers": f"WITH {SENT}, {_TOKENS}, v AS (SELECT w, {_VECTORS} FROM (SELECT DISTINCT token AS w FROM tok)), {_outliers('tok', 'v')} SELECT * FROM out",
    "token_features": f"""{_ALL}, {_FWD}, {_BWD}, {_TOKENS}, v AS (SELECT w, {_VECTORS} FROM (SELECT DISTINCT token AS w FROM tok) WHERE length(w) % 2 = 0), {_outliers('tok', 'v')}
SELECT f.doc_id, f.sent_pos, f.token_idx, f.token, round((f.s + r.s) / 2, 6) + 0.0 AS ngram_surp, ft_outlier, round(ln(1 + c), 6) + 0.0 AS log_freq, length(f.token)::DOUBLE AS char_len
FROM f JOIN r USING (doc_id, sent_pos, token_idx) JOIN out USING (doc_id, sent_pos, token_idx) JOIN u ON u.w = f.token""",
    "gap_detector": f"""{_COR}, dg AS (SELECT cg.doc_id, cg.sent_pos, cg.gap_idx, round(0.5 * (-ln((coalesce(b.c, 0) + {A}) / (ul.c + {A} * {_V})) - ln((coalesce(b.c, 0) + {A}) / (ur.c + {A} * {_V}))), 6) + 0.0 AS score
FROM cg LEFT JOIN b ON b.w1 = l AND b.w = r LEFT JOIN u AS ul ON ul.w = l LEFT JOIN u AS ur ON ur.w = r),
scored AS (SELECT 'gap_score' AS method, score, (loc.gap_idx IS NOT NULL)::INTEGER AS label FROM dg LEFT JOIN loc ON loc.doc_id = dg.doc_id AND loc.sent_pos = dg.sent_pos AND loc.gap_idx = dg.gap_idx),
{_curve()}, {_best(compat=False)} SELECT method, round(average_precision, 6) + 0.0 AS average_precision, threshold, round(f1, 6) + 0.0 AS f1 FROM ap JOIN best USING (method)""",
    "normalize_text": f"SELECT doc_id, {_normalized('text')} AS normalized FROM documents",
    "pages_text": f"SELECT page_id, {_normalized('html')} AS normalized FROM pages",
    "sentences": f"WITH {SENT} SELECT doc_id, sent_pos, array_to_string(tokens, ' ') AS tokens, len(tokens)::BIGINT AS n_tokens FROM sent",
    "sentence_numbers": f"WITH {SENT} SELECT doc_id, sent_pos, 's' || (row_number() OVER (ORDER BY doc_id, sent_pos) - 1)::VARCHAR AS sent_id FROM sent",
    "tokens": f"WITH {SENT} SELECT doc_id, sent_pos, (i - 1)::INTEGER AS token_idx, tokens[i] AS token FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM sent)",
    "sentence_lengths": f"WITH {SENT} SELECT len(tokens)::BIGINT AS n_tokens, count(*) AS n_sentences FROM sent GROUP BY 1",
    "train_test_split": f"WITH {SENT} SELECT doc_id, sent_pos, {_draw(7, 'split')} < 0.75 AS is_train FROM sent",
    "unigrams": f"{_ALL} SELECT w, c FROM u",
    "bigrams": f"{_ALL} SELECT w1, w, c FROM b",
    "trigrams": f"{_ALL} SELECT w2, w1, w, c FROM t",
    "lm_stats": f"{_ALL} SELECT * FROM st",
    "token_surprisal_fwd": f"{_ALL}, {_FWD} SELECT doc_id, sent_pos, token_idx, token, round(s, 6) + 0.0 AS surprisal FROM f",
    "token_surprisal_bwd": f"{_ALL}, {_BWD} SELECT doc_id, sent_pos, token_idx, token, round(s, 6) + 0.0 AS surprisal FROM r",
    "token_surprisal_bidi": f"{_ALL}, {_FWD}, {_BWD} SELECT doc_id, sent_pos, token_idx, f.token, round((f.s + r.s) / 2, 6) + 0.0 AS surprisal FROM f JOIN r USING (doc_id, sent_pos, token_idx)",
    "gap_scores": f"{_ALL}, {_GAPS} SELECT doc_id, sent_pos, gap_idx, l AS left_token, r AS right_token, gap_score FROM gs",
    "gap_top": f"{_ALL}, {_GAPS} SELECT doc_id, sent_pos, gap_idx, l AS left_token, r AS right_token, gap_score, row_number() OVER (ORDER BY gap_score DESC, doc_id, sent_pos, gap_idx)::INTEGER AS rank FROM gs ORDER BY rank LIMIT 20",
    "bigram_neglogprob": f"{_ALL} SELECT b.w1 AS left_token, b.w AS right_token, round(-ln((b.c + {A}) / (u.c + {A} * {_V})), 6) + 0.0 AS neglogprob FROM b JOIN u ON u.w = b.w1 WHERE b.w1 <> '<s>' AND b.w <> '</s>'",
    "top_vocab": f"{_ALL} SELECT w, c, row_number() OVER (ORDER BY c DESC, w DESC)::INTEGER AS rank FROM u WHERE w NOT IN ('<s>', '</s>') ORDER BY rank LIMIT 3000",
    "token_freq_len": f"{_LOG_FREQ} SELECT * FROM tl",
    "confusables": f"""{_COR}, tgt AS (SELECT DISTINCT orig AS target FROM cor WHERE s IS NOT NULL),
near AS (SELECT target, w FROM (SELECT target, w, row_number() OVER (PARTITION BY target ORDER BY w) AS k FROM tgt JOIN vocab ON substr(w, 1, 1) = substr(target, 1, 1) AND abs(length(w) - length(target)) <= 2 AND w <> target) WHERE k <= 2000 AND levenshtein(target, w) <= 2)
SELECT target, choice FROM tgt LEFT JOIN (SELECT target, arg_min(w, md5('7|' || target || '|' || w)) AS choice FROM near GROUP BY 1) USING (target)""",
    "corrupt_confusable": f"""{_COR}, tgt AS (SELECT DISTINCT orig AS target FROM cor WHERE s IS NOT NULL),
near AS (SELECT target, w FROM (SELECT target, w, row_number() OVER (PARTITION BY target ORDER BY w) AS k FROM tgt JOIN vocab ON substr(w, 1, 1) = substr(target, 1, 1) AND abs(length(w) - length(target)) <= 2 AND w <> target) WHERE k <= 2000 AND levenshtein(target, w) <= 2)
SELECT doc_id, sent_pos, s AS pos, orig AS original, coalesce(choice, new) AS replacement FROM cor LEFT JOIN (SELECT target, arg_min(w, md5('8|' || target || '|' || w)) AS choice FROM near GROUP BY 1) ON target = orig WHERE s IS NOT NULL""",
    "lr_predict": f"{_LOG_FREQ} SELECT doc_id, sent_pos, token_idx, round(1 / (1 + exp(-(-1.5 - 0.8 * (log_freq - 3.0) / 2.0 + 0.3 * (char_len - 6.0) / 2.5))), 6) + 0.0 AS lr_score FROM tl",
    "matched_scores": f"{_COR}, {_GAPS} SELECT gap_score AS score, (loc.gap_idx IS NOT NULL)::INTEGER AS label FROM gs JOIN cg USING (doc_id, sent_pos, gap_idx) LEFT JOIN loc ON loc.doc_id = gs.doc_id AND loc.sent_pos = gs.sent_pos AND loc.gap_idx = gs.gap_idx",
    "split_exact_counts": f"WITH {SENT}, d AS (SELECT doc_id, sent_pos, row_number() OVER (ORDER BY {_draw(7, 'split')}, doc_id, sent_pos) AS k, count(*) OVER () AS n FROM sent) SELECT doc_id, sent_pos, k <= floor(n * 0.75) AS is_train FROM d",
    "top_examples_tokens": f"""{_ALL}, {_FWD}, {_TOP_TOKENS}, {_suggested("tgt")}, lst AS (SELECT place, string_agg(candidate, ', ' ORDER BY rank) AS suggestions FROM sug GROUP BY 1)
SELECT top.place::INTEGER AS rank, round(s, 6) + 0.0 AS surprisal, top.token AS item, array_to_string(list_concat(tokens[1:token_idx], ['**' || tokens[token_idx + 1] || '**'], tokens[token_idx + 2:]), ' ') AS sentence, coalesce(suggestions, '(нет)') AS suggestions
FROM top JOIN sent USING (doc_id, sent_pos) LEFT JOIN lst ON lst.place = top.place""",
    "levenshtein_limited": "SELECT p.p_partkey, CASE WHEN levenshtein(p.p_name, q.p_name) <= 8 THEN levenshtein(p.p_name, q.p_name) ELSE -1 END AS distance FROM part AS p JOIN part AS q ON q.p_partkey = p.p_partkey + 1",
    "corrupt_deletions": f"{_COR} SELECT doc_id, sent_pos, d AS pos, dtok AS token, dl AS left_token, dr AS right_token FROM cor WHERE d IS NOT NULL",
    "corrupt_substitutions": f"{_COR} SELECT doc_id, sent_pos, s AS pos, orig AS original, new AS replacement FROM cor WHERE s IS NOT NULL",
    "corrupted_sentences": f"{_COR} SELECT doc_id, sent_pos, array_to_string(tc, ' ') AS tokens_corrupted FROM cor",
    "token_labels": f"{_TOKEN_LABELS} SELECT * FROM tl",
    "gap_labels": f"{_COR} SELECT cg.doc_id, cg.sent_pos, cg.gap_idx::INTEGER AS gap_idx, (loc.gap_idx IS NOT NULL)::INTEGER AS label FROM cg LEFT JOIN loc ON loc.doc_id = cg.doc_id AND loc.sent_pos = cg.sent_pos AND loc.gap_idx = cg.gap_idx",
    "located_deletions": f"{_COR} SELECT doc_id, sent_pos, dtok AS token, coalesce(gap_idx, -1) AS gap_idx FROM loc",
    "pr_curve": f"WITH {_SCORED}, {_curve()} SELECT method, position::INTEGER AS position, threshold, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall FROM curve",
    "average_precision": f"WITH {_SCORED}, {_curve()} SELECT method, round(average_precision, 6) + 0.0 AS average_precision FROM ap",
    "best_f1_compat": f"WITH {_SCORED}, {_curve()}, {_best()} SELECT method, threshold, round(f1, 6) + 0.0 AS f1 FROM best",
    "best_f1_corrected": f"WITH {_SCORED}, {_curve()}, {_best(compat=False)} SELECT method, threshold, round(f1, 6) + 0.0 AS f1 FROM best",
    "prf_at_threshold": f"WITH {_SCORED}, lim AS (SELECT 'value' AS method, 10.0::DOUBLE AS threshold UNION ALL SELECT 'user_mod', 8.0) SELECT method, threshold, round(p, 6) + 0.0 AS precision, round(r, 6) + 0.0 AS recall, {_F1} FROM ({_prf('scored', 'lim')})",
    "compare_methods": f"""WITH {_SCORED}, part AS (SELECT *, {_uniform("'7'", "'events'", "event_id::VARCHAR")} < 0.75 AS is_train FROM scored), a AS (SELECT * FROM part WHERE is_train), z AS (SELECT * FROM part WHERE NOT is_train),
{_curve("a", "a_")}, {_best("a_")}, {_curve("z", "z_")}
SELECT method, threshold, round(p, 6) + 0.0 AS precision, round(r, 6) + 0.0 AS recall, {_F1}, round(average_precision, 6) + 0.0 AS average_precision FROM ({_prf("z", "(SELECT method, threshold FROM a_best)")}) JOIN z_ap USING (method)""",
    "suggest_replacements": f"{_ALL}, {_FWD}, {_TOP_TOKENS}, {_suggested('tgt')} SELECT place::INTEGER AS place, rank::INTEGER AS rank, candidate, score FROM sug",
    "suggest_insertions": f"{_ALL}, {_GAPS}, {_TOP_GAPS}, {_suggested('tgt')} SELECT place::INTEGER AS place, rank::INTEGER AS rank, candidate, score FROM sug",
    "correction_topk": f"""WITH {SENT}, {_SPLIT}, {_lm("tr")}, {_corrupt("te", "u", 9)},
ev AS MATERIALIZED (SELECT row_number() OVER () AS place, * FROM (SELECT 'substitution' AS kind, orig AS truth, {_around("tc", "(s + 1)")} FROM cor WHERE s IS NOT NULL UNION ALL
       SELECT 'deletion', dtok, {_between("tc", "gap_idx")} FROM loc WHERE gap_idx IS NOT NULL)), {_suggested("ev")}
SELECT kind, count(*) AS events, round(avg((coalesce(rank, 99) <= 1)::INTEGER), 6) + 0.0 AS top1, round(avg((coalesce(rank, 99) <= 5)::INTEGER), 6) + 0.0 AS topk
FROM ev LEFT JOIN sug ON sug.place = ev.place AND sug.candidate = ev.truth GROUP BY 1""",
    "embedding_outlier": f"""WITH e AS ({_EMB}), m AS (SELECT a.vec_id, a.e, list(b.e) AS near FROM e AS a LEFT JOIN e AS b ON a.g = b.g AND a.i <> b.i AND abs(a.i - b.i) <= 5 GROUP BY a.vec_id, a.e),
k AS (SELECT vec_id, e, list_transform(range(1, len(e) + 1), lambda d: list_avg(list_transform(near, lambda v: v[d]))) AS c FROM m) SELECT vec_id, round(1 - {_COS.format("e", "c")}, 6) + 0.0 AS outlier FROM k""",
    "cosine_pairs": f"WITH e AS ({_EMB}) SELECT a.vec_id, round({_COS.format('a.e', 'b.e')}, 6) + 0.0 AS cosine FROM e AS a JOIN e AS b ON b.vec_id = a.vec_id + 1",
    "scaler_stats": f"{_LOG_FREQ} SELECT 'log_freq' AS feature, round(avg(log_freq), 6) + 0.0 AS mean, round(stddev_pop(log_freq), 6) + 0.0 AS std FROM tl UNION ALL SELECT 'char_len', round(avg(char_len), 6) + 0.0, round(stddev_pop(char_len), 6) + 0.0 FROM tl",
    "class_weights": f"{_TOKEN_LABELS} SELECT label, count(*) AS n, round((SELECT count(*) FROM tl) / (2 * count(*)), 6) + 0.0 AS weight FROM tl GROUP BY 1",
    "render_sentence": f"{_COR} SELECT doc_id, sent_pos, array_to_string(list_concat(tc[1:s], ['**' || tc[s + 1] || '**'], tc[s + 2:]), ' ') AS rendered FROM cor WHERE s IS NOT NULL",
    "render_gap": f"{_COR} SELECT doc_id, sent_pos, array_to_string(list_concat(tc[1:gap_idx + 1], ['**[?]**'], tc[gap_idx + 2:]), ' ') AS rendered FROM loc WHERE gap_idx IS NOT NULL",
    "top_examples": f"""{_ALL}, {_GAPS}, {_TOP_GAPS}, {_suggested("tgt")}, lst AS (SELECT place, string_agg(candidate, ', ' ORDER BY rank) AS suggestions FROM sug GROUP BY 1)
SELECT top.place::INTEGER AS rank, gap_score, l || ' ' || r AS item, array_to_string(list_concat(tokens[1:gap_idx + 1], ['**[?]**'], tokens[gap_idx + 2:]), ' ') AS sentence, coalesce(suggestions, '(нет)') AS suggestions
FROM top JOIN sent USING (doc_id, sent_pos) LEFT JOIN lst ON lst.place = top.place""",
}
