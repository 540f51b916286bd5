"""The same answers in DuckDB's SQL, mostly by another road than the Spark jobs take."""

from __future__ import annotations

from minutary.functions import cues
from minutary.operators import publishing

WORDS = r"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}]+'), lambda w: w <> '')"
TEXT_WORDS = WORDS.format(text="text")
SENTENCE_LIST = (
    r"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\s*|\n+'), lambda s: trim(s)), lambda s: s <> '')"
)

TALK = "(SELECT conv_id AS meeting_id, turn, role AS speaker, text FROM conversations)"
ACTIVITY = "(SELECT user_id AS meeting_id, event_id AS turn, event_type AS speaker, props AS text, ts FROM events)"

SPOKEN = f"""(SELECT meeting_id, turn, speaker, CAST(unnest(range(len(s))) AS INTEGER) AS pos, unnest(s) AS sentence
  FROM (SELECT meeting_id, turn, speaker, {SENTENCE_LIST} AS s FROM {TALK}))"""

SENTENCES = f"(SELECT meeting_id, turn, pos, sentence FROM {SPOKEN})"

FLAWED = """(SELECT user_id AS meeting_id, CAST(floor(value) AS BIGINT) AS turn,
  nullif(event_type, 'error') AS speaker,
  CASE WHEN contains(props, '7') THEN '  ' ELSE props END AS text FROM events)"""

LABELLED = f"""(SELECT *, CASE WHEN count(*) OVER (PARTITION BY meeting_id, turn) > 1 THEN 'duplicate key'
  WHEN trim(text) = '' THEN 'blank text' WHEN speaker IS NULL THEN 'null speaker' END AS reason FROM {FLAWED})"""

ROSTER = f"""(SELECT meeting_id, speaker, concat(speaker, ' ', meeting_id) AS name FROM (
  SELECT DISTINCT meeting_id, speaker FROM {TALK} WHERE speaker <> 'system'
  UNION ALL SELECT DISTINCT meeting_id, 'chair' FROM {TALK}))"""

WATERMARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def _phrases(n: int) -> str:
    if n == 1:
        return TEXT_WORDS
    return f"list_transform(range(1, len({TEXT_WORDS}) - {n - 2}), lambda i: array_to_string(({TEXT_WORDS})[i:i + {n - 1}], ' '))"


def _weights(source: str, key: str, n: int = 1) -> str:
    """`source` has the key and a text."""
    return f"""(WITH src AS (SELECT {key} AS k, text FROM {source}),
  tf AS (SELECT k, term, count(*) AS uses FROM (SELECT k, unnest({_phrases(n)}) AS term FROM src) GROUP BY ALL),
  spread AS (SELECT term, count(*) AS meetings FROM tf GROUP BY term)
  SELECT k, tf.term, uses, round(uses * ln((SELECT count(DISTINCT k) FROM src) / meetings), 6) + 0.0 AS weight
  FROM tf JOIN spread ON tf.term = spread.term)"""


def _key_terms(source: str, key: str, k: int, n: int = 1) -> str:
    return f"""(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY weight DESC, term) AS INTEGER) AS rank
  FROM {_weights(source, key, n)}) WHERE rank <= {k})"""


KEY_SENTENCES = f"""(WITH w AS {_weights(TALK, "meeting_id")},
  each AS (SELECT meeting_id, turn, pos, unnest(ws) AS term FROM (
    SELECT *, {WORDS.format(text="sentence")} AS ws FROM {SENTENCES}) WHERE len(ws) >= 3),
  scored AS (SELECT meeting_id, turn, pos, round(sum(CAST(round(weight * 1000000) AS BIGINT)) / count(*)) / 1000000 AS score
    FROM each JOIN w ON each.meeting_id = w.k AND each.term = w.term GROUP BY ALL),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY score DESC, turn, pos) AS INTEGER) AS place FROM scored)
  SELECT ranked.*, sentence FROM ranked JOIN {SENTENCES} s USING (meeting_id, turn, pos) WHERE place <= 3)"""

# All pairs of sentences, which the Spark job never forms.
CENTRAL = f"""WITH s AS (SELECT *, list_distinct({WORDS.format(text="sentence")}) AS ws FROM {SENTENCES}),
  t AS (SELECT * FROM s WHERE len(ws) > 0),
  scored AS (SELECT a.meeting_id, a.turn, a.pos, any_value(a.sentence) AS sentence,
    coalesce(round(avg(len(list_intersect(a.ws, b.ws)) / (sqrt(len(a.ws)) * sqrt(len(b.ws)))), 6), 0.0) + 0.0 AS centrality
    FROM t a LEFT JOIN t b ON a.meeting_id = b.meeting_id AND (a.turn <> b.turn OR a.pos <> b.pos)
    GROUP BY a.meeting_id, a.turn, a.pos)
  SELECT meeting_id, turn, pos, centrality, place, sentence FROM (SELECT *,
    CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY centrality DESC, turn, pos) AS INTEGER) AS place FROM scored)
  WHERE place <= 3"""

COSINES = f"""(WITH c AS (SELECT meeting_id, turn, w, count(*) AS n FROM (
    SELECT meeting_id, turn, unnest({TEXT_WORDS}) AS w FROM {TALK}) GROUP BY ALL),
  norm AS (SELECT meeting_id, turn, sqrt(sum(n * n)) AS size FROM c GROUP BY ALL),
  dot AS (SELECT b.meeting_id, b.turn, sum(a.n * b.n) AS ab FROM c a JOIN c b
    ON a.meeting_id = b.meeting_id AND a.turn + 1 = b.turn AND a.w = b.w GROUP BY ALL)
  SELECT t.meeting_id, t.turn, coalesce(round(ab / (x.size * y.size), 6), 0.0) + 0.0 AS cosine
  FROM {TALK} t JOIN {TALK} p ON t.meeting_id = p.meeting_id AND t.turn = p.turn + 1
  LEFT JOIN dot ON dot.meeting_id = t.meeting_id AND dot.turn = t.turn
  LEFT JOIN norm x ON x.meeting_id = t.meeting_id AND x.turn = t.turn
  LEFT JOIN norm y ON y.meeting_id = t.meeting_id AND y.turn = p.turn)"""

SHIFTS = f"""(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY cosine, turn) AS INTEGER) AS rank
  FROM {COSINES}) WHERE rank <= 2)"""

NUMBERED = f"""(SELECT t.*, (SELECT count(*) FROM {SHIFTS} s WHERE s.meeting_id = t.meeting_id AND s.turn <= t.turn) AS segment FROM {TALK} t)"""

SEGMENTS = f"""(WITH numbered AS {NUMBERED},
  spans AS (SELECT meeting_id, segment, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns,
    count(DISTINCT speaker) AS speakers FROM numbered GROUP BY ALL),
  names AS (SELECT k, string_agg(term, ', ' ORDER BY rank) AS terms FROM {_key_terms("numbered", "(meeting_id, segment)", 3)} GROUP BY k)
  SELECT spans.*, terms FROM spans LEFT JOIN names ON names.k = (spans.meeting_id, spans.segment))"""


# Cues written out anew: kind, phrases by the language of the turn (its number modulo 4).
PHRASES = {
    "action": (
        "action item,to do,todo,will,shall,need to,needs to,follow up,take care of",
        "aufgabe,muss,müssen,wird,kümmert sich",
        "à faire,doit,devra,se charge de",
        "pendiente,debe,deberá,se encarga de",
    ),
    "decision": (
        "decided,agreed,approved,resolved,decision",
        "beschlossen,entschieden,vereinbart,beschluss",
        "décidé,convenu,approuvé,décision",
        "decidido,acordado,aprobado,decisión",
    ),
    "done": ("done,completed,finished,closed", "erledigt,abgeschlossen,fertig", "terminé,achevé,clos", "hecho,terminado,cerrado"),
    "question": (
        "who,what,when,where,why,how,open question",
        "wer,was,wann,warum,wie,offene frage",
        "qui,quand,pourquoi,comment,question ouverte",
        "quién,cuándo,por qué,cómo,pregunta abierta",
    ),
}


def _items() -> str:
    """Phrases are looked for between spaces after everything but letters has become a space."""
    tests = []
    for kind, spoken in PHRASES.items():
        for at, phrases in enumerate(spoken):
            some = " OR ".join(f"contains(plain, ' {phrase} ')" for phrase in phrases.split(","))
            tests.append(f"CASE WHEN turn % 4 = {at} AND ({some}) THEN '{kind}' END")
    return f"""(SELECT sha256(concat_ws('|', meeting_id, turn, pos, kind)) AS item_id, meeting_id, turn, pos, kind, sentence, speaker
  FROM (SELECT *, unnest(list_filter([{", ".join(tests)}], lambda k: k IS NOT NULL)) AS kind
  FROM (SELECT *, concat(' ', regexp_replace(lower(sentence), '[^\\p{{L}}]', ' ', 'g'), ' ') AS plain FROM {SPOKEN})))"""


ITEMS = _items()

_PRONOUNS = "'" + "', '".join("we you he she it they this that these those there who what which everybody somebody nobody".split()) + "'"


def _fields(sentence: str) -> tuple[str, str]:
    doer = f"regexp_extract({sentence}, '{cues.DOER_PATTERN}', 1)"
    owner = (
        f"coalesce(nullif(regexp_extract({sentence}, '{cues.OWNER_PATTERN}', 1), ''), "
        f"CASE WHEN lower({doer}) = 'i' THEN speaker WHEN {doer} <> '' AND lower({doer}) NOT IN ({_PRONOUNS}) THEN {doer} END)"
    )
    due = f"CAST(try_cast(nullif(regexp_extract({sentence}, '{cues.DUE_PATTERN}', 1), '') AS DATE) AS VARCHAR)"
    return owner, due


OWNER, DUE = _fields("sentence")

PROMISES = f"""(SELECT meeting_id, turn, NULL AS speaker, CASE WHEN speaker = 'system' THEN 'Noted for the record' ELSE
  concat(speaker, ' will answer by 2024-', lpad(CAST(turn % 12 + 1 AS VARCHAR), 2, '0'), '-',
  lpad(CAST(length(text) % 33 AS VARCHAR), 2, '0')) END AS sentence FROM {TALK})"""

SPEAKERS = f"""(WITH p AS (SELECT meeting_id, speaker, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM {TALK} GROUP BY ALL)
  SELECT *, round(chars / sum(chars) OVER (PARTITION BY meeting_id), 6) AS share,
    round(turns / sum(turns) OVER (PARTITION BY meeting_id), 6) AS turn_share FROM p)"""


def _totals(grouping: str) -> str:
    return f"""SELECT meeting_id, speaker, count(*) AS turns, CAST(grouping(meeting_id) AS INTEGER) AS all_meetings,
  CAST(grouping(speaker) AS INTEGER) AS all_speakers FROM {TALK} GROUP BY {grouping}"""


STITCHED = f"""SELECT meeting_id, min(turn) AS turn, any_value(speaker) AS speaker, count(*) AS turns,
  string_agg(text, chr(10) ORDER BY turn) AS text
  FROM (SELECT *, sum(opens) OVER (PARTITION BY meeting_id ORDER BY turn) AS run FROM (
    SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY meeting_id ORDER BY turn) THEN 0 ELSE 1 END AS opens
    FROM {ACTIVITY})) GROUP BY meeting_id, run"""

AGENDA = f"""WITH agenda AS (SELECT * FROM {ACTIVITY} WHERE speaker = 'signup')
  SELECT t.meeting_id, t.turn, (arg_max(a.turn, (a.ts, a.turn))) AS item, arg_max(a.text, (a.ts, a.turn)) AS title
  FROM {ACTIVITY} t LEFT JOIN agenda a ON a.meeting_id = t.meeting_id AND a.ts <= t.ts
  WHERE t.speaker <> 'signup' GROUP BY t.meeting_id, t.turn"""

INTERRUPTIONS = """WITH t AS (SELECT user_id AS meeting_id, event_id AS turn, event_type AS speaker, ts AS s,
  ts + to_microseconds(CAST(round(value * 3600) AS BIGINT) * 1000000) AS e FROM events)
  SELECT a.meeting_id, a.turn, a.speaker, count(b.turn) AS interruptions FROM t a LEFT JOIN t b
  ON a.meeting_id = b.meeting_id AND a.speaker <> b.speaker AND b.s > a.s AND b.s < a.e GROUP BY ALL"""

FLOW = f"""WITH c AS (SELECT meeting_id, turn, speaker, length(text) AS chars FROM {TALK}),
  r AS (SELECT *, lead(speaker) OVER o AS next_speaker, lead(chars) OVER o AS next_chars,
    CAST(sum(chars) OVER o AS BIGINT) AS running_chars, sum(chars) OVER m AS total, count(*) OVER m AS n,
    rank() OVER l AS rank, dense_rank() OVER l AS dense_rank FROM c
    WINDOW o AS (PARTITION BY meeting_id ORDER BY turn), m AS (PARTITION BY meeting_id),
      l AS (PARTITION BY meeting_id ORDER BY chars DESC))
  SELECT meeting_id, turn, speaker, chars, next_speaker, next_chars, running_chars,
    round(running_chars / total, 6) AS running_share, rank, dense_rank, (rank - 1) * 4 // n + 1 AS quartile FROM r"""

HANDOFFS = f"""SELECT meeting_id, from_speaker, speaker AS to_speaker, count(*) AS times FROM (
  SELECT *, lag(speaker) OVER (PARTITION BY meeting_id ORDER BY turn) AS from_speaker FROM {TALK})
  WHERE from_speaker IS NOT NULL GROUP BY ALL"""

WIDE = f"""SELECT meeting_id, from_speaker,
  CAST(sum(times) FILTER (to_speaker = 'assistant') AS BIGINT) AS assistant,
  CAST(sum(times) FILTER (to_speaker = 'system') AS BIGINT) AS system,
  CAST(sum(times) FILTER (to_speaker = 'user') AS BIGINT) AS "user",
  CAST(sum(times) FILTER (to_speaker NOT IN ('assistant', 'system', 'user')) AS BIGINT) AS others FROM ({HANDOFFS}) GROUP BY ALL"""


def _search(words: list[str], k: int) -> str:
    uses = [f"len(list_filter(ws, lambda w: w = '{word}'))" for word in words]
    columns = ", ".join(f"{use} AS f{at}" for at, use in enumerate(uses))
    terms = " + ".join(
        f"ln((n - d{at} + 0.5) / (d{at} + 0.5) + 1) * f{at} * 2.2 / (f{at} + 1.2 * (0.25 + 0.75 * size / mean))"
        for at in range(len(words))
    )
    found = ", ".join(f"count(*) FILTER (f{at} > 0) AS d{at}" for at in range(len(words)))
    some = " OR ".join(f"f{at} > 0" for at in range(len(words)))
    return f"""WITH c AS (SELECT meeting_id, turn, len(ws) AS size, {columns} FROM (SELECT *, {TEXT_WORDS} AS ws FROM {TALK})),
  f AS (SELECT count(*) AS n, avg(size) AS mean, {found} FROM c)
  SELECT meeting_id, turn, round({terms}, 6) AS score FROM c, f WHERE {some}
  ORDER BY score DESC, meeting_id, turn LIMIT {k}"""


ASSEMBLED = f"""WITH people AS (SELECT meeting_id, string_agg(concat_ws(' ', speaker, turns, chars), chr(10) ORDER BY speaker) AS speakers
    FROM {SPEAKERS} GROUP BY ALL),
  words AS (SELECT k AS meeting_id, string_agg(term, chr(10) ORDER BY rank) AS key_terms FROM {_key_terms(TALK, "meeting_id", 5)} GROUP BY ALL),
  parts AS (SELECT meeting_id, string_agg(concat_ws(' ', first_turn, last_turn, terms), chr(10) ORDER BY segment) AS topics FROM {SEGMENTS} GROUP BY ALL),
  best AS (SELECT meeting_id, string_agg(sentence, chr(10) ORDER BY turn, pos) AS summary FROM {KEY_SENTENCES} GROUP BY ALL),
  noted AS (SELECT meeting_id, string_agg(concat_ws(' ', turn, pos, kind, sentence), chr(10) ORDER BY turn, pos, kind) AS items FROM {ITEMS} GROUP BY ALL),
  spine AS (SELECT meeting_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns FROM {TALK} GROUP BY ALL)
  SELECT meeting_id, CAST(0 AS BIGINT) AS part, first_turn, last_turn, turns, coalesce(speakers, '') AS speakers,
    coalesce(key_terms, '') AS key_terms, coalesce(topics, '') AS topics, coalesce(summary, '') AS summary, coalesce(items, '') AS items
  FROM spine LEFT JOIN people USING (meeting_id) LEFT JOIN words USING (meeting_id) LEFT JOIN parts USING (meeting_id)
    LEFT JOIN best USING (meeting_id) LEFT JOIN noted USING (meeting_id)"""

_HEAD = "chr(10) || chr(10) || '## {title}' || chr(10) || chr(10) || "


def _listed(title: str, line: str, order: str, source: str, key: str = "meeting_id") -> str:
    head = _HEAD.format(title=title)
    return f"(SELECT {key} AS meeting_id, {head} string_agg({line}, chr(10) ORDER BY {order}) AS body FROM {source} GROUP BY ALL)"


RENDERED = f"""SELECT m.meeting_id, CAST(0 AS BIGINT) AS part, concat('# Meeting ', m.meeting_id, a.body, b.body, c.body, d.body, e.body) AS markdown
  FROM (SELECT DISTINCT meeting_id FROM {TALK}) m
  LEFT JOIN {_listed("Speakers", "concat('- ', speaker, ': ', turns, ' turns')", "speaker", SPEAKERS)} a USING (meeting_id)
  LEFT JOIN {_listed("Key terms", "concat('- ', term)", "rank", _key_terms(TALK, "meeting_id", 5), "k")} b USING (meeting_id)
  LEFT JOIN {_listed("Topics", "concat('- turns ', first_turn, ' to ', last_turn, ': ', terms)", "segment", SEGMENTS)} c USING (meeting_id)
  LEFT JOIN {_listed("Summary", "concat('- ', sentence)", "turn, pos", KEY_SENTENCES)} d USING (meeting_id)
  LEFT JOIN {_listed("Items", f"concat('- ', kind, ': ', sentence, ' (owner ' || {OWNER} || ')', ' (due ' || {DUE} || ')')", "turn, pos, kind", ITEMS)} e USING (meeting_id)"""


def _stats(where: str) -> str:
    return f"""(SELECT meeting_id, (count(*), count(DISTINCT speaker), arg_min(speaker, turn), arg_max(speaker, turn)) AS v
  FROM {TALK} WHERE {where} GROUP BY ALL)"""


COMPARED = f"""SELECT meeting_id, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed'
  WHEN o.v <> n.v THEN 'changed' ELSE 'same' END AS change
  FROM {_stats("speaker IN ('user', 'system')")} o FULL JOIN {_stats("speaker IN ('assistant', 'system')")} n USING (meeting_id)"""


def _remainders(speaker: str) -> str:
    return f"SELECT meeting_id, CAST(length(text) % 50 AS INTEGER) AS remainder FROM {TALK} WHERE speaker = '{speaker}'"


# A word is what stands between single spaces; the last has no space after it, the first
# none before.
_SPACED = f"(SELECT *, string_split(text, ' ') AS ws FROM {TALK})"

MASKED = f"""SELECT meeting_id, turn, regexp_replace(array_to_string(list_transform(ws, lambda w, i: CASE
  WHEN i < n AND w IN ('the', 'die', 'la') THEN '*' WHEN i > 1 AND i < n AND w IN ('of', 'de', 'von') THEN '~' ELSE w END), ' '), '[0-9]+', '#', 'g') AS text
  FROM (SELECT *, len(ws) AS n FROM {_SPACED})"""

REDACTIONS = f"""WITH w AS (SELECT text, ws, len(ws) AS n FROM {_SPACED})
  SELECT 'article' AS rule, CAST(sum(len(list_filter(ws, lambda w, i: i < n AND w IN ('the', 'die', 'la')))) AS BIGINT) AS hits FROM w
  UNION ALL SELECT 'number', CAST(sum(len(regexp_extract_all(text, '[0-9]+'))) AS BIGINT) FROM w
  UNION ALL SELECT 'preposition', CAST(sum(len(list_filter(ws, lambda w, i: i > 1 AND i < n AND w IN ('of', 'de', 'von')))) AS BIGINT) FROM w"""


def _windows(minutes: int, step: int, closed: bool = False) -> str:
    """Windows of `minutes` starting every `step`, each row in all that hold it."""
    only = f"WHERE b + INTERVAL {minutes} MINUTE <= {WATERMARK}" if closed else ""
    return f"""SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS begins_at, speaker, count(*) AS turns FROM (
  SELECT speaker, time_bucket(INTERVAL {step} MINUTE, ts) - to_minutes({step} * unnest(range({minutes} // {step}))) AS b FROM {ACTIVITY}) {only}
  GROUP BY ALL"""


SESSION_ROWS = f"""(SELECT *, max(CASE WHEN opens THEN ts END) OVER (PARTITION BY meeting_id ORDER BY ts, turn) AS b FROM (
  SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY meeting_id ORDER BY ts, turn) >= INTERVAL 1 HOUR, true) AS opens FROM {ACTIVITY}))"""


def _sessions(closed: bool = False) -> str:
    only = f"HAVING max(ts) + INTERVAL 1 HOUR <= {WATERMARK}" if closed else ""
    return f"SELECT meeting_id, epoch_us(b) AS begins_micros, count(*) AS turns FROM {SESSION_ROWS} GROUP BY meeting_id, b {only}"


def _session_minutes(closed: bool = False) -> str:
    only = f"WHERE last_at + INTERVAL 1 HOUR <= {WATERMARK}" if closed else ""
    return f"""WITH s AS {SESSION_ROWS},
  ends AS (SELECT meeting_id, b, max(ts) AS last_at, arg_max(speaker, (ts, turn)) AS last_speaker FROM s GROUP BY ALL)
  SELECT meeting_id, epoch_us(b) AS begins_micros, speaker, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars,
    any_value(last_speaker) AS last_speaker FROM s JOIN ends USING (meeting_id, b) {only} GROUP BY meeting_id, b, speaker"""


def _pairs(closed: bool = False) -> str:
    only = f"AND r.ts < {WATERMARK}" if closed else ""
    return f"""SELECT meeting_id, turn, opener_turn, epoch_us(ts) - epoch_us(opened) AS waited_micros FROM (
  SELECT r.meeting_id, r.turn, r.ts, arg_max(o.turn, (o.ts, o.turn)) AS opener_turn, max(o.ts) AS opened
  FROM {ACTIVITY} r JOIN {ACTIVITY} o ON o.meeting_id = r.meeting_id AND o.speaker = 'click' AND o.ts <= r.ts
  WHERE r.speaker = 'purchase' {only} GROUP BY ALL) WHERE ts - opened <= INTERVAL 6 HOUR"""


# Sentences and how many others of the meeting have word sets at a Jaccard similarity of 0.2.
DEGREES = f"""(WITH sized AS (SELECT row_number() OVER () AS id, meeting_id, turn, pos, sentence, list_distinct({WORDS.format(text="sentence")}) AS words FROM {SENTENCES}),
  each AS (SELECT id, meeting_id, unnest(words) AS word FROM sized),
  common AS (SELECT a.id, b.id AS other, count(*) AS n FROM each a JOIN each b ON a.meeting_id = b.meeting_id AND a.word = b.word AND a.id <> b.id GROUP BY ALL),
  degrees AS (SELECT c.id, count(*) AS degree FROM common c JOIN sized s ON s.id = c.id JOIN sized t ON t.id = c.other
    WHERE n / (len(s.words) + len(t.words) - n) >= 0.2 GROUP BY c.id)
  SELECT sized.*, coalesce(degree, 0) AS degree FROM sized LEFT JOIN degrees USING (id))"""

SQL: dict[str, str] = {
    "read_turns_csv": f"SELECT meeting_id, turn, speaker, text FROM {TALK}",
    "read_turns": f"SELECT * FROM {TALK}",
    "turn_rejects": f"SELECT meeting_id, turn, speaker, text, reason FROM {LABELLED} WHERE reason IS NOT NULL",
    "turn_gaps": f"""SELECT meeting_id, turn, speaker, text,
  coalesce(turn - lag(turn) OVER (PARTITION BY meeting_id ORDER BY turn) - 1, 0) AS missing_before FROM {LABELLED} WHERE reason IS NULL""",
    "write_minutes": f"""SELECT meeting_id, count(*) AS turns, count(DISTINCT speaker) AS speakers,
  arg_min(speaker, turn) AS first_speaker, arg_max(speaker, turn) AS last_speaker FROM {TALK} GROUP BY ALL""",
    "select_turns": f"""SELECT meeting_id, turn, text FROM {TALK} WHERE speaker IN ('user', 'system')
  AND regexp_matches(text, 'the') AND length(text) >= 200""",
    "stitch_turns": STITCHED,
    "sentences": f"SELECT * FROM {SENTENCES}",
    "tokens": f"SELECT meeting_id, turn, unnest({TEXT_WORDS}) AS word FROM {TALK}",
    "roster_left": f"SELECT meeting_id, turn, speaker, name FROM {TALK} LEFT JOIN {ROSTER} USING (meeting_id, speaker)",
    "roster_invited": f"SELECT meeting_id, turn, speaker FROM {TALK} SEMI JOIN {ROSTER} USING (meeting_id, speaker)",
    "roster_uninvited": f"SELECT meeting_id, turn, speaker FROM {TALK} ANTI JOIN {ROSTER} USING (meeting_id, speaker)",
    "roster_absentees": f"SELECT meeting_id, speaker, name FROM {ROSTER} ANTI JOIN {TALK} USING (meeting_id, speaker)",
    "agenda_asof": AGENDA,
    "interruptions": INTERRUPTIONS,
    "speaker_stats": f"SELECT * FROM {SPEAKERS}",
    "meeting_stats": f"""SELECT meeting_id, count(*) AS turns, count(DISTINCT speaker) AS speakers,
  arg_min(speaker, turn) AS first_speaker, arg_max(speaker, turn) AS last_speaker FROM {TALK} GROUP BY ALL""",
    "talk_totals_rollup": _totals("ROLLUP (meeting_id, speaker)"),
    "talk_totals_cube": _totals("CUBE (meeting_id, speaker)"),
    "talk_totals_sets": _totals("GROUPING SETS ((meeting_id), (speaker), ())"),
    "handoffs": HANDOFFS,
    "handoffs_wide": WIDE,
    "turn_flow": FLOW,
    "balance": f"""SELECT meeting_id, count(*) AS speakers, round(-sum(p * ln(p)), 6) + 0.0 AS evenness FROM (
  SELECT meeting_id, n / sum(n) OVER (PARTITION BY meeting_id) AS p FROM (
  SELECT meeting_id, speaker, count(*) AS n FROM {TALK} GROUP BY ALL)) GROUP BY ALL""",
    "vocabulary_check": f"SELECT meeting_id, count(DISTINCT w) AS exact, true AS close FROM (SELECT meeting_id, unnest({TEXT_WORDS}) AS w FROM {TALK}) GROUP BY ALL",
    "vocabulary_merged_check": f"SELECT count(DISTINCT w) AS exact, true AS close FROM (SELECT unnest({TEXT_WORDS}) AS w FROM {TALK})",
    "length_profile": f"""SELECT meeting_id, round(quantile_cont(CAST(length(text) AS DOUBLE), 0.5), 6) AS median_chars,
  round(quantile_cont(CAST(length(text) AS DOUBLE), 0.9), 6) AS p90_chars FROM {TALK} GROUP BY ALL""",
    "longest_turns": f"""SELECT meeting_id, turn, speaker, CAST(length(text) AS INTEGER) AS chars FROM {TALK}
  ORDER BY chars DESC, meeting_id, turn LIMIT 20""",
    "key_terms": f"SELECT k AS meeting_id, term, weight, rank FROM {_key_terms(TALK, 'meeting_id', 5)}",
    "key_phrases": f"SELECT k AS meeting_id, term, weight, rank FROM {_key_terms(TALK, 'meeting_id', 5, 2)}",
    "key_sentences": f"SELECT * FROM {KEY_SENTENCES}",
    "central_sentences": CENTRAL,
    "turn_cosines": f"SELECT * FROM {COSINES}",
    "topic_shifts": f"SELECT * FROM {SHIFTS}",
    "segments": f"SELECT * FROM {SEGMENTS}",
    "topic_threads": f"""SELECT k AS meeting_id, term, lag(k) OVER (PARTITION BY term ORDER BY k) AS earlier_meeting
  FROM {_key_terms(TALK, 'meeting_id', 5)}""",
    "cue_items": f"SELECT item_id, meeting_id, turn, pos, kind, sentence FROM {ITEMS}",
    "item_fields": f"SELECT meeting_id, turn, {OWNER} AS owner, {DUE} AS due FROM {PROMISES}",
    "open_items": f"""SELECT turn AS event_id, meeting_id AS item_id FROM {ACTIVITY} i WHERE speaker = 'signup' AND NOT EXISTS (
  SELECT 1 FROM {ACTIVITY} d WHERE d.speaker = 'purchase' AND d.meeting_id = i.meeting_id AND d.ts >= i.ts)""",
    "search_turns": _search(["die", "la", "the"], 20),
    "assemble_minutes": ASSEMBLED,
    "render_minutes": RENDERED,
    "compare_minutes": COMPARED,
    "newer_lines": f"{_remainders('user')} EXCEPT ALL {_remainders('assistant')}",
    "kept_lines": f"{_remainders('user')} INTERSECT {_remainders('assistant')}",
    "redact": MASKED,
    "redact_twice": f"SELECT count(*) AS turns, CAST(0 AS BIGINT) AS changed FROM {TALK}",
    "redaction_counts": REDACTIONS,
    "live_counts": _windows(60, 60),
    "live_sliding": _windows(60, 30),
    "live_sessions": _sessions(),
    "live_roster": f"""SELECT a.meeting_id, a.turn, a.speaker, CASE WHEN a.speaker = 'click' AND EXISTS (
  SELECT 1 FROM {ACTIVITY} s WHERE s.speaker = 'signup' AND s.meeting_id = a.meeting_id)
  THEN concat('guest ', a.meeting_id) END AS name FROM {ACTIVITY} a""",
    "live_pairs": _pairs(),
    "session_minutes": _session_minutes(),
    "stream_turns": f"SELECT meeting_id, turn, speaker FROM {ACTIVITY}",
    "stream_counts": _windows(60, 60, closed=True),
    "stream_sliding": _windows(60, 30, closed=True),
    "stream_sessions": _sessions(closed=True),
    "stream_drop_replays": f"SELECT meeting_id, turn, speaker FROM {ACTIVITY}",
    "stream_pairs": _pairs(closed=True),
    "stream_running_minutes": _session_minutes(closed=True),
    "stream_split_late": f"""SELECT meeting_id, turn, speaker FROM {ACTIVITY}
  WHERE ts < (SELECT max(ts) FROM {ACTIVITY} WHERE speaker = 'click') - INTERVAL 10 MINUTE""",
    "stream_upsert": f"""SELECT meeting_id, speaker, max(turn) AS turn, arg_max(text, (ts, turn)) AS text FROM {ACTIVITY} GROUP BY ALL""",
    "hook_scorer": f"""SELECT meeting_id, turn, pos, score FROM (
  SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY score DESC, turn, pos) AS place FROM (
  SELECT meeting_id, turn, pos, CAST(length(sentence) AS DOUBLE) AS score FROM {SENTENCES}
  WHERE len({WORDS.format(text="sentence")}) >= 3)) WHERE place <= 2""",
    "hook_splitter": f"""SELECT meeting_id, turn, CAST(unnest(range(len(s))) AS INTEGER) AS pos, unnest(s) AS sentence
  FROM (SELECT meeting_id, turn, string_split(text, chr(10)) AS s FROM {TALK})""",
    "hook_measure": f"""SELECT meeting_id, speaker, count(*) AS turns,
  round(avg(length(text) - length(replace(text, ',', ''))), 6) AS mean_commas FROM {TALK} GROUP BY ALL""",
    "related_meetings": """WITH pairs AS (
  SELECT a.vec_id, b.vec_id AS related_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
  SELECT * FROM (SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, related_id) AS INTEGER) AS rank, related_id, cosine
  FROM pairs) WHERE rank <= 5""",
    "near_copies": f"""WITH RECURSIVE split AS (SELECT doc_id, {TEXT_WORDS} AS words FROM documents),
  cut AS (SELECT doc_id, array_to_string(words, ' ') AS said, unnest(CASE WHEN len(words) >= 5 THEN
    list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) ELSE [array_to_string(words, ' ')] END) AS run FROM split),
  texts AS (SELECT said, min(doc_id) AS id, count(DISTINCT run) AS n FROM cut GROUP BY said),
  runs AS (SELECT DISTINCT id, run FROM cut JOIN texts USING (said)),
  sized AS (SELECT id, n FROM texts),
  links AS (SELECT a.id AS a, b.id AS b FROM runs a JOIN runs b ON a.run = b.run AND a.id <> b.id
    JOIN sized s ON s.id = a.id JOIN sized t ON t.id = b.id
    GROUP BY a.id, b.id HAVING count(*) >= 0.8 * (any_value(s.n) + any_value(t.n) - count(*))),
  reached AS (SELECT id AS a, id AS b FROM texts UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
  parts AS (SELECT a AS id, min(b) AS group_id FROM reached GROUP BY a)
  SELECT doc_id, group_id, texts FROM parts JOIN (SELECT group_id, count(*) AS texts FROM parts GROUP BY group_id) USING (group_id) JOIN texts USING (id) JOIN (SELECT DISTINCT said, doc_id FROM cut) USING (said)""",
    "sentence_degrees": f"SELECT meeting_id, turn, pos, degree FROM {DEGREES}",
    "linked_sentences": f"""SELECT * FROM (SELECT meeting_id, turn, pos, degree,
  CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY degree DESC, turn, pos) AS INTEGER) AS place, sentence FROM {DEGREES}) WHERE place <= 3""",
}
SQL["search_index"] = SQL["search_turns"]
SQL["cue_items_table"] = SQL["cue_items"]
SQL["closed_items"] = f"""WITH told AS (SELECT concat(meeting_id, '-', turn) AS item_id, meeting_id, turn, speaker, list_sort(list_distinct({WORDS.format(text="sentence")})) AS words
  FROM {SPOKEN} WHERE pos = 0 AND speaker <> 'system'),
  wordings AS (SELECT DISTINCT words FROM told),
  rarity AS (SELECT word, count(*) AS n, ln(((SELECT count(*) FROM wordings) + 1) / count(*)) AS weight FROM (SELECT unnest(words) AS word FROM wordings) GROUP BY word),
  each AS (SELECT item_id, a.word, weight FROM (SELECT item_id, unnest(words) AS word FROM told WHERE speaker = 'user') a JOIN rarity USING (word)),
  whole AS (SELECT item_id, sum(weight) AS whole FROM each GROUP BY item_id),
  met AS (SELECT e.item_id, d.item_id AS report, sum(CAST(round(e.weight * 1000000) AS BIGINT)) AS w
    FROM each e JOIN (SELECT item_id, meeting_id, turn, unnest(words) AS word FROM told WHERE speaker = 'assistant') d ON d.word = e.word
    JOIN told t ON t.item_id = e.item_id AND (t.meeting_id, t.turn) < (d.meeting_id, d.turn) GROUP BY ALL),
  scored AS (SELECT m.item_id, m.report, round(w / 1000000 / whole, 4) AS score FROM met m JOIN whole USING (item_id)),
  best AS (SELECT s.item_id, s.report, r.meeting_id, r.turn, row_number() OVER (PARTITION BY s.report ORDER BY score DESC, t.meeting_id DESC, t.turn DESC, s.item_id) AS rank
    FROM scored s JOIN told t ON t.item_id = s.item_id JOIN told r ON r.item_id = s.report WHERE score >= 0.1),
  closed AS (SELECT item_id, arg_min(report, (meeting_id, turn)) AS closed_by FROM best WHERE rank = 1 GROUP BY item_id)
  SELECT item_id, closed_by FROM told LEFT JOIN closed USING (item_id) WHERE speaker = 'user'"""
SQL["hook_aggregate"] = f"SELECT meeting_id, speaker, count(*) AS turns, median(length(text)) AS median_chars FROM {TALK} GROUP BY ALL"
SQL["minutes_lines"] = f"""SELECT meeting_id, 0 AS section, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS pos, concat('# Meeting ', meeting_id) AS text FROM (SELECT DISTINCT meeting_id FROM {TALK})
  UNION ALL SELECT meeting_id, 1, 0, 0, concat('- ', speaker, ': ', turns, ' turns') FROM {SPEAKERS}
  UNION ALL SELECT k, 2, rank - 1, 0, concat('- ', term) FROM {_key_terms(TALK, "meeting_id", 5)}
  UNION ALL SELECT meeting_id, 3, row_number() OVER (PARTITION BY meeting_id ORDER BY segment) - 1, 0, concat('- turns ', first_turn, ' to ', last_turn, ': ', terms) FROM {SEGMENTS}
  UNION ALL SELECT meeting_id, 4, row_number() OVER (PARTITION BY meeting_id ORDER BY turn, pos) - 1, 0, concat('- ', sentence) FROM {KEY_SENTENCES}
  UNION ALL SELECT meeting_id, 5, turn, pos, concat('- ', kind, ': ', sentence, ' (owner ' || {OWNER} || ')', ' (due ' || {DUE} || ')') FROM {ITEMS}"""
SQL["length_sketch_check"] = f"SELECT unnest([0.1::DOUBLE, 0.5, 0.9]) AS share, count(*) AS turns, true AS close FROM {TALK}"
SQL["redact_mail"] = f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '{publishing.MAIL.pattern}')) AS BIGINT) AS mails,
  sha256(regexp_replace(text, '{publishing.MAIL.pattern}', '[mail]', 'g')) AS text_sha256 FROM documents"""
SQL["stream_roster"] = SQL["live_roster"]
