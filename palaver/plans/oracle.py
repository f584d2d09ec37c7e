"""DuckDB SQL that restates each registered query.

Column rules of the input tables come from the adapter; everything else is written
independently of the DataFrame code.
"""

from __future__ import annotations

from palaver import fixed
from palaver.plans.adapter import COPIES, NO_LABEL, ODD_LABEL, RULES, SECOND_LABEL
from palaver.operators.training import MAX_FEATURES
from palaver.plans.catalogue import (
    EVENT_HINTS,
    MIN_LENGTH,
    PERIOD,
    NO_ID,
    MANY_PATTERNS,
    PATTERNS,
    QUARTILES,
    SAMPLE,
    SCORE_THRESHOLD,
    SEARCHED,
    TERM,
    TEST_SAMPLES,
    WEEKLY_TARGET,
    WIDE,
)
from palaver.plans.toys import CHARACTERS, GAIN

WS, W = fixed.WS_SET, fixed.WORD_SET
BAR = "'|'"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def text_list(values) -> str:
    return "[" + ", ".join(map(quote, values)) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(map(quote, values)) + ")"


EMO = text_list(fixed.EMOTIONS)
POS, NEG = text_list(fixed.POSITIVE_EMOTIONS), text_list(fixed.NEGATIVE_EMOTIONS)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def strip_urls(x: str) -> str:
    stop = fixed.URL_STOP_SET.replace("'", "''")
    links = f"regexp_replace({x}, {quote(fixed.MARKDOWN_LINK)}, '\\1', 'g')"
    urls = rf"regexp_replace({links}, '(?i)https?://[^{stop}]+|www\.[^{stop}]+', ' ', 'g')"
    return strip(f"regexp_replace({urls}, '[{WS}]+', ' ', 'g')")


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[{W}]+')"


def metrics(x: str) -> str:
    return (
        f"cast(length({x}) as integer) as comment_length, "
        f"cast(len(regexp_extract_all({x}, '[^{WS}]+')) as integer) as comment_word_count"
    )


def sentiment(labels: str) -> str:
    return (
        f"case when list_has_any({labels}, {NEG}) then 'negative' "
        f"when list_has_any({labels}, {POS}) then 'positive' else 'neutral' end"
    )


def f1(tp: str, fp: str, fn: str) -> str:
    p = f"(case when {tp} + {fp} > 0 then {tp} / ({tp} + {fp}) else 0.0 end)"
    r = f"(case when {tp} + {fn} > 0 then {tp} / ({tp} + {fn}) else 0.0 end)"
    return f"(case when {p} + {r} > 0 then 2 * {p} * {r} / ({p} + {r}) else 0.0 end)"


# --- input tables --------------------------------------------------------------

_COLUMNS = ", ".join(f"{sql} as {name}" for name, sql in RULES.items())
RAW = f"""
source_rows as (
  select d.doc_id, d.text, d.lang, d.source, o.o_orderdate as comment_at, e.value,
         p.o_orderkey as post_key, p.o_orderdate as post_at, p.o_totalprice as post_price,
         unnest(range(0, {COPIES})) as copy_no
  from documents d
  join orders o on o.o_orderkey = d.doc_id
  join events e on e.event_id = d.doc_id
  join orders p on p.o_orderkey = d.doc_id - d.doc_id % 7
),
bare as (select {_COLUMNS} from source_rows),
raw as (select *, {metrics('comment_body')} from bare)"""

CLEAN = f"""{RAW},
firsts as (
  select * exclude (comment_length, comment_word_count) from raw
  qualify row_number() over (partition by comment_id order by ingest_order) = 1
),
no_bots as (
  select * from firsts where coalesce(comment_author not in ('AutoModerator', 'automoderator'), true)
),
no_deleted as (
  select * from no_bots where lower({strip('comment_body')}) not in ('[deleted]', '[removed]')
),
no_urls as (
  select * replace ({strip_urls('comment_body')} as comment_body) from no_deleted
),
cleaned as (
  select *, {metrics('comment_body')} from no_urls where {strip('comment_body')} <> ''
)"""


def labels(shift_every: int | None, odd: bool) -> str:
    def name(a: int, b: int) -> str:
        return f"{EMO}[(doc_id * {a} + {b}) % 28 + 1]"

    first = name(5, 0)
    if shift_every:
        first = f"case when doc_id % {shift_every} = 1 then {name(5, 1)} else {first} end"
    sql = (
        f"case when {NO_LABEL} then cast([] as varchar[]) "
        f"when {SECOND_LABEL} then [{first}, {name(11, 3)}] else [{first}] end"
    )
    if odd:
        sql = (
            f"list_concat({sql}, case when {ODD_LABEL} then ['weird'] "
            "else cast([] as varchar[]) end)"
        )
    return sql


PREDICTED = f"""{CLEAN},
labelled as (select *, {labels(None, True)} as emotions from cleaned),
predicted as (
  select *, array_to_string(emotions, '|') as predicted_emotions,
         {sentiment('emotions')} as predicted_sentiment
  from labelled
),
hits as (
  select comment_id, comment_created_at, unnest(list_distinct(emotions)) as emotion
  from predicted
)"""

EVALUATED = f"""{CLEAN},
judged as (
  select 'model_a' as model, 'Model A' as model_label, doc_id as id,
         {labels(4, False)} as truth, {labels(None, True)} as guess from cleaned
  union all
  select 'model_b', 'Model B', doc_id, {labels(4, False)}, {labels(5, True)} from cleaned
)"""


def confusion(rows: str, vocabulary: str) -> str:
    """CTEs ``cells`` (per label) from rows(model, model_label, truth, guess)."""
    return f"""
vocabulary as (select unnest({vocabulary}) as label),
cells as (
  select model, model_label, label,
         count(*) filter (where list_contains(truth, label) and list_contains(guess, label)) as tp,
         count(*) filter (where not list_contains(truth, label) and list_contains(guess, label)) as fp,
         count(*) filter (where list_contains(truth, label) and not list_contains(guess, label)) as fn,
         count(*) filter (where list_contains(truth, label)) as support
  from {rows} cross join vocabulary group by model, model_label, label
),
pooled as (
  select model, model_label, avg({f1('tp', 'fp', 'fn')}) as macro_f1,
         {f1('sum(tp)', 'sum(fp)', 'sum(fn)')} as micro_f1, sum(fp + fn) as wrong
  from cells group by model, model_label
)"""


OVERLAP = f"""
setwise as (
  select model, model_label, count(*) as n,
         avg(case when list_sort(list_distinct([x for x in truth if list_contains({EMO}, x)]))
                     = list_sort(list_distinct([x for x in guess if list_contains({EMO}, x)]))
             then 1.0 else 0.0 end) as accuracy,
         avg(case when len(truth) = 0 and len(guess) = 0 then 1.0
             else len(list_intersect(truth, guess))
                  / len(list_distinct(list_concat(truth, guess))) end) as mean_jaccard,
         avg(case when (len(truth) = 0 and len(guess) = 0) or list_has_any(truth, guess)
             then 1.0 else 0.0 end) as at_least_one_match
  from judged group by model, model_label
)"""
SENTIMENT_JUDGED = f"""
judged3 as (
  select model, model_label, [{sentiment('truth')}] as truth, [{sentiment('guess')}] as guess
  from judged
)"""
SENTIMENTS = text_list(fixed.SENTIMENTS)

TERMS = f"""
tokens as (
  select comment_id, unnest(t) as token, generate_subscripts(t, 1) as pos
  from (
    select comment_id, regexp_extract_all(lower(comment_body), '[a-z0-9'']+') as t from cleaned
  )
),
terms as (
  select comment_id, pos, replace(token, '''', '') as term from tokens
  where length(replace(token, '''', '')) >= 3
    and replace(token, '''', '') not in {in_list(fixed.STOPWORDS)}
)"""


def bins(edges, column: str) -> str:
    rows = ", ".join(f"({quote(label)}, {low}, {high})" for label, low, high in edges)
    return f"""select b.bin, count(c.comment_id) as count
from (values {rows}) b(bin, low, high)
left join cleaned c on c.{column} > b.low and c.{column} <= b.high
group by b.bin"""


def keyword_rows(patterns: tuple[tuple[str, str], ...] = fixed.KEYWORDS) -> str:
    """Counts with every separator doubled, so neighbouring hits share none."""
    rows = []
    for label, pattern in patterns:
        inner = pattern.replace(r"\b", "").replace(r"[\s-]?", rf"([{WS}-][{WS}-])?")
        inner = inner.replace(" ", "  ")
        rows.append(
            f"select {quote(label)} as keyword, "
            f"len(regexp_extract_all(spaced, '[^{W}]{inner}[^{W}]')) as n from doubled"
        )
    return " union all ".join(rows)


def lexicon() -> str:
    rows = [f"({quote(w)}, 'positive')" for w in fixed.POSITIVE_WORDS]
    rows += [f"({quote(w)}, 'negative')" for w in fixed.NEGATIVE_WORDS]
    return f"(values {', '.join(rows)}) l(word, polarity)"


# A post's first row decides, known or not.
FIRST_SCORES = """
first_scores as (
  select post_id, post_score as score from raw
  qualify row_number() over (partition by post_id order by ingest_order) = 1
)"""
MONTH = "strftime(comment_created_at, '%Y-%m')"
PROMPT_HEAD = quote(fixed.PROMPT_HEAD + ", ".join(fixed.EMOTIONS) + fixed.PROMPT_TAIL)
GROUP = (
    f"case when emotion in {in_list(fixed.POSITIVE_EMOTIONS)} then 'positive' "
    f"when emotion in {in_list(fixed.NEGATIVE_EMOTIONS)} then 'negative' else 'neutral' end"
)
FULL = f"""{PREDICTED},
full_counts as (
  select v.emotion, count(h.comment_id) as comments,
         count(h.comment_id) / (select count(*) from predicted) as share
  from (select unnest({EMO}) as emotion) v left join hits h on h.emotion = v.emotion
  group by v.emotion
)"""


def toy_scored(name: str, threshold: float) -> str:
    hits = f"length(comment_body) - length(replace(comment_body, {quote(CHARACTERS)}[i], ''))"
    return f"""{name} as (
  select *, [{EMO}[i] for i in range(1, 29)
    if {GAIN} * ({hits}) / greatest(length(comment_body), 1)
       >= cast({threshold} as double)] as emotions
  from cleaned
)"""


TOY = f"{CLEAN}, {toy_scored('scored', 0.5)}"
SHA = "sha256(text)"
CACHED = f"""
texts as (
  select sha256(text) as text_sha256, any_value(text) as text, count(*) as copies
  from documents group by sha256(text)
),
answers as (
  select text_sha256, copies, text_sha256[1] < '8' as cached,
         case when text_sha256[1] < '8'
              then {EMO}[instr('0123456789abcdef', text_sha256[2])]
              when length({PROMPT_HEAD} || text) % 2 = 0 then 'joy' else 'anger' end as labels
  from texts
)"""


def _reply(i: int) -> str:
    a, b = f"{EMO}[(doc_id * 5) % 28 + 1]", f"{EMO}[(doc_id * 11 + 3) % 28 + 1]"
    return [
        f"""concat(' {{"emotions": ["', upper({a}), ' ", "x", "', {a}, '", "', {b}, '"]}}', chr(10))""",
        f"""concat('{{"labels":"', {a}, '"}}')""",
        f"""concat('ok: {{"emotions": ["', {a}, '"]}} end')""",
        f"""concat('I feel ', {a}, ', and ', {b}, '. ', comment_body)""",
        f"""concat('["', {a}, '", 5]')""",
        """'{"emotions": []}'""",
        f"""concat('{{"labels": ["', {b}, '"], "emotions": null, "note": "', {a}, '"}}')""",
        f"""concat('"', {a}, '"')""",
        f"""concat('{{"emotions": ["', {b}, '"], "note": {{"emotions": 1}}, "emotions": ["', {a}, '"]}}')""",
        f"""concat('so {{"emotions": "', {b}, '", "emotions": ["x", "', {a}, '"]}} end')""",
    ][i]


REPLIES = " ".join(f"when {i} then {_reply(i)}" for i in range(10))
# What the replies with a repeated key say last.
LAST_SAID = f"""when 8 then concat('{{"emotions": ["', {EMO}[(doc_id * 5) % 28 + 1], '"]}}')
  when 9 then concat('{{"emotions": ["x", "', {EMO}[(doc_id * 5) % 28 + 1], '"]}}')"""

_START, _END = (moment.isoformat(" ") for moment in PERIOD)
_WEEKS = -(-(PERIOD[1] - PERIOD[0]).days // 7)
_BASE, _EXTRA = divmod(WEEKLY_TARGET, _WEEKS)

_PREDICTION_PREVIEW = (
    "comment_body, predicted_emotions, predicted_sentiment, comment_score, "
    "comment_author, comment_created_at"
)


def with_(ctes: str, body: str) -> str:
    return f"with {ctes.strip().lstrip(',')}\n{body}"


def summary_of(judged: str) -> str:
    """The benchmark summary of a CTE ``judged``."""
    return with_(
        f"{judged}, {SENTIMENT_JUDGED}, {confusion('judged', EMO)}, {OVERLAP}, "
        + confusion("judged3", SENTIMENTS)
        .replace("vocabulary", "vocabulary3")
        .replace("cells", "cells3")
        .replace("pooled", "pooled3"),
        """select model, e.model_label, round(e.macro_f1, 4) as emotion_macro_f1,
  round(e.micro_f1, 4) as emotion_micro_f1, round(s.accuracy, 4) as emotion_subset_accuracy,
  round(s.at_least_one_match, 4) as emotion_at_least_one_match,
  round(s.mean_jaccard, 4) as emotion_mean_jaccard,
  round(cast(e.wrong as double) / (s.n * 28), 4) as emotion_hamming_loss,
  round(t.macro_f1, 4) as sentiment_macro_f1, round(t.micro_f1, 4) as sentiment_micro_f1,
  round(a.accuracy, 4) as sentiment_accuracy
from pooled e join setwise s using (model) join pooled3 t using (model)
join (select model, avg(case when truth = guess then 1.0 else 0.0 end) as accuracy
      from judged3 group by model) a using (model)""",
    )


ORACLE: dict[str, str] = {
    "clean_comments": with_(CLEAN, "select * exclude (ingest_order, doc_id) from cleaned"),
    "clean_min_length": with_(
        CLEAN,
        "select comment_id, comment_length, comment_word_count from cleaned "
        f"where comment_length >= {MIN_LENGTH}",
    ),
    "cleaning_funnel": with_(
        CLEAN,
        f"""select 0 as step_no, 'Raw dataset' as step, (select count(*) from raw) as rows
union all select 1, 'After deduplicating comments', (select count(*) from firsts)
union all select 2, 'After removing AutoModerator', (select count(*) from no_bots)
union all select 3, 'After removing [deleted] / [removed]', (select count(*) from no_deleted)
union all select 4, 'After stripping URLs', (select count(*) from no_urls)
union all select 5, 'After removing empty comments', (select count(*) from cleaned)
union all select 6, 'After min length ({MIN_LENGTH})',
  (select count(*) from cleaned where comment_length >= {MIN_LENGTH})
union all select 7, 'Final cleaned dataset',
  (select count(*) from cleaned where comment_length >= {MIN_LENGTH})""",
    ),
    "removed_rows": with_(
        CLEAN,
        """select a as raw_rows, b as clean_rows, a - b as removed, (a - b) / a * 100 as removed_pct
from (select (select count(*) from raw) as a, (select count(*) from cleaned) as b)""",
    ),
    "dedupe_keep_first": with_(
        RAW,
        """select comment_id,
  first(concat('v', cast(ingest_order as varchar), ' ', comment_body) order by ingest_order)
    as comment_body
from raw group by comment_id""",
    ),
    "stripped_urls": with_(
        RAW,
        f"select ingest_order, comment_length, {strip_urls('comment_body')} as stripped from raw",
    ),
    "dataset_summary": with_(
        RAW,
        """select count(*) as comments, count(distinct post_id) as posts,
  count(distinct comment_author) as authors,
  min(post_created_at) as post_start, max(post_created_at) as post_end,
  min(comment_created_at) as comment_start, max(comment_created_at) as comment_end,
  cast(median(comment_length) as double) as median_comment_length,
  avg(comment_length) as mean_comment_length,
  cast(median(comment_word_count) as double) as median_words,
  (select cast(median(n) as double) from (select count(*) as n from raw group by post_id))
    as median_comments_per_post,
  avg(post_score) as mean_post_score, avg(comment_score) as mean_comment_score,
  avg(case when comment_author = 'AutoModerator' then 1.0 else 0.0 end) as automod_share
from raw""",
    ),
    "monthly_volume": with_(
        CLEAN,
        f"select {MONTH} as month, count(comment_id) as comments, "
        "count(distinct post_id) as posts from cleaned group by 1",
    ),
    "weekday_volume": with_(
        CLEAN,
        "select dayname(comment_created_at) as weekday, count(comment_id) as comments "
        "from cleaned group by 1",
    ),
    "length_bins": with_(CLEAN, bins(fixed.LENGTH_BINS, "comment_length")),
    "score_bins": with_(CLEAN, bins(fixed.SCORE_BINS, "comment_score")),
    "length_histogram": with_(
        f"""{CLEAN},
limits as (select min(comment_length) as lo, max(comment_length) as hi from cleaned),
placed as (
  select least(39, (comment_length - lo) * 40 // (hi - lo)) as bin from cleaned, limits
)""",
        """select cast(b.i as integer) as bin, lo + b.i * ((hi - lo) / 40.0) as bin_start,
  lo + (b.i + 1) * ((hi - lo) / 40.0) as bin_end,
  (select count(*) from placed where placed.bin = b.i) as count
from (select unnest(range(0, 40)) as i) b, limits""",
    ),
    "top_authors": with_(
        CLEAN,
        "select comment_author, count(comment_id) as comments, avg(comment_score) as mean_score "
        "from cleaned where comment_author is not null group by 1 "
        "order by comments desc, comment_author limit 15",
    ),
    "post_stats": with_(
        CLEAN,
        "select post_id, first(post_score order by ingest_order) "
        "filter (where post_score is not null) as post_score, count(comment_id) as comments "
        "from cleaned group by 1",
    ),
    "top_posts": with_(
        CLEAN,
        "select post_id, post_title, count(comment_id) as comments, "
        "first(post_score order by ingest_order) filter (where post_score is not null) as post_score "
        "from cleaned group by 1, 2 order by comments desc, post_id limit 10",
    ),
    "word_frequencies": with_(
        f"{CLEAN}, {TERMS}",
        "select term, count(*) as count, count(*) / (select count(*) from terms) as share "
        "from terms group by term order by count desc, term limit 50",
    ),
    "cloud_terms": with_(
        f"{CLEAN}, {TERMS}",
        "select term, count(*) as count from terms group by term order by count desc, term limit 200",
    ),
    "bigram_frequencies": with_(
        f"""{CLEAN}, {TERMS},
pairs as (
  select term || ' ' || lead(term) over (partition by comment_id order by pos) as bigram from terms
)""",
        "select bigram, count(*) as count from pairs where bigram is not null "
        "group by bigram order by count desc, bigram limit 30",
    ),
    "emoji_frequencies": with_(
        CLEAN,
        f"""select emoji, count(*) as count
from (select unnest(regexp_extract_all(comment_body, '[{fixed.EMOJI_SET}]+')) as emoji from cleaned)
group by emoji order by count desc, emoji limit 20""",
    ),
    "comments_containing_term": with_(
        f"""{CLEAN},
matches as (
  select * from cleaned
  where regexp_matches(lower(comment_body), '(^|[^{W}]){TERM}([^{W}]|$)')
)""",
        "select post_title, comment_body, comment_score, comment_author, "
        "(select count(*) from matches) as total_matches "
        "from matches order by comment_id limit 10",
    ),
    "keyword_frequencies": with_(
        f"""{CLEAN},
doubled as (
  select ' ' || regexp_replace(lower(comment_body), '([^{W}])', '\\1\\1', 'g') || ' ' as spaced
  from cleaned
),
counted as ({keyword_rows()})""",
        """select keyword, count(*) filter (where n > 0) as comments_with_keyword,
  cast(sum(n) as bigint) as total_mentions,
  round(count(*) filter (where n > 0) / count(*) * 100, 2) as pct_comments
from counted group by keyword""",
    ),
    "keyword_frequencies_many": with_(
        f"""{CLEAN},
doubled as (
  select ' ' || regexp_replace(lower(comment_body), '([^{W}])', '\\1\\1', 'g') || ' ' as spaced
  from cleaned
),
counted as ({keyword_rows(MANY_PATTERNS)})""",
        """select keyword, count(*) filter (where n > 0) as comments_with_keyword,
  cast(sum(n) as bigint) as total_mentions,
  round(count(*) filter (where n > 0) / count(*) * 100, 2) as pct_comments
from counted group by keyword""",
    ),
    "term_index_search": with_(
        CLEAN,
        " union all ".join(
            f"""(select {quote(term)} as term, post_title, comment_body, comment_score, comment_author,
  count(*) over () as total_matches from cleaned
where regexp_matches(lower(comment_body), '(^|[^{W}]){term}([^{W}]|$)')
order by comment_id limit 10)"""
            for term in SEARCHED
        ),
    ),
    "score_quartiles": with_(
        PREDICTED,
        "select predicted_sentiment, count(x) as n, "
        + ", ".join(f"round(quantile_cont(x, {q}), 9) as q{i + 1}" for i, q in enumerate(QUARTILES))
        + " from (select predicted_sentiment, cast(comment_score as double) / "
        "(length(comment_body) + 0.5) as x from predicted) where x is not null group by 1",
    ),
    "lexicon_word_counts": with_(
        f"{CLEAN}, found as (select unnest({words('comment_body')}) as word from cleaned)",
        "select word, polarity, count(*) as count from found "
        f"join {lexicon()} using (word) group by word, polarity",
    ),
    "lexicon_summary": with_(
        f"""{CLEAN},
counted as (
  select len([w for w in t if list_contains({text_list(fixed.POSITIVE_WORDS)}, w)]) as p,
         len([w for w in t if list_contains({text_list(fixed.NEGATIVE_WORDS)}, w)]) as n
  from (select {words('comment_body')} as t from cleaned)
)""",
        """select cast(sum(p) as bigint) as positive_mentions, cast(sum(n) as bigint) as negative_mentions,
  count(*) filter (where p > 0) as comments_with_positive,
  count(*) filter (where n > 0) as comments_with_negative,
  round(count(*) filter (where p > 0) / count(*) * 100, 2) as pct_positive_comments,
  round(count(*) filter (where n > 0) / count(*) * 100, 2) as pct_negative_comments
from counted""",
    ),
    "emotion_frequency": with_(
        PREDICTED,
        "select emotion, count(*) as comments, "
        "count(*) / (select count(*) from predicted) as share "
        "from hits group by emotion order by comments desc, emotion limit 28",
    ),
    "headline_emotions": with_(
        f"{PREDICTED}, freq as (select emotion, count(*) as n from hits group by emotion)",
        f"""select (select count(*) from predicted) as comments_scored,
  (select count(*) from freq where emotion in {in_list(fixed.EMOTIONS)}) as emotions_seen,
  (select emotion from freq order by n desc, emotion limit 1) as top_emotion,
  (select max(n) from freq) / (select count(*) from predicted) as top_share""",
    ),
    "emotion_frequency_all": with_(FULL, "select emotion, comments, share from full_counts"),
    "emotions_with_group": with_(
        FULL, f"select emotion, comments, share, {GROUP} as sentiment_group from full_counts"
    ),
    "group_hits": with_(
        FULL,
        f"select {GROUP} as sentiment_group, cast(sum(comments) as bigint) as comments "
        "from full_counts group by 1",
    ),
    "monthly_emotion_trend": with_(
        f"""{PREDICTED},
best as (select emotion from hits group by emotion order by count(*) desc, emotion limit 8),
month_list as (select distinct {MONTH} as month from predicted)""",
        f"""select m.month, b.emotion, count(h.comment_id) as comments
from month_list m cross join best b
left join (select *, {MONTH} as month from hits) h on h.month = m.month and h.emotion = b.emotion
group by m.month, b.emotion""",
    ),
    "monthly_emotion_share": with_(
        f"""{PREDICTED},
month_list as (select distinct {MONTH} as month from predicted),
trend as (
  select m.month, b.emotion, count(h.comment_id) as comments
  from month_list m cross join (values ('joy'), ('anger'), ('pride')) b(emotion)
  left join (select *, {MONTH} as month from hits) h on h.month = m.month and h.emotion = b.emotion
  group by m.month, b.emotion
)""",
        "select month, emotion, comments, "
        "comments / nullif(sum(comments) over (partition by month), 0) as share from trend",
    ),
    "emotion_cooccurrence": with_(
        PREDICTED,
        "select a.emotion as emotion_a, b.emotion as emotion_b, count(*) as comments, "
        "a.emotion || ' + ' || b.emotion as pair from hits a join hits b "
        "on a.comment_id = b.comment_id and a.emotion < b.emotion group by 1, 2 "
        "order by comments desc, emotion_a, emotion_b limit 20",
    ),
    "emotion_cooccurrence_matrix": with_(
        f"""{PREDICTED},
best as (select emotion from hits group by emotion order by count(*) desc, emotion limit 12),
both_hits as (
  select a.emotion as ea, b.emotion as eb, count(*) as n
  from hits a join hits b on a.comment_id = b.comment_id group by 1, 2
)""",
        "select x.emotion as emotion_a, y.emotion as emotion_b, coalesce(n, 0) as comments "
        "from best x cross join best y left join both_hits on ea = x.emotion and eb = y.emotion",
    ),
    "labels_per_comment": with_(
        PREDICTED,
        "select cast(len(string_split(predicted_emotions, '|')) as integer) as labels_per_comment, "
        "count(*) as comments from predicted group by 1",
    ),
    "sentiment_distribution": with_(
        PREDICTED,
        f"""select s.sentiment, count(p.comment_id) as comments,
  count(p.comment_id) / (select count(*) from predicted) as share,
  round(count(p.comment_id) / (select count(*) from predicted) * 100, 1) as share_pct
from (select unnest({SENTIMENTS}) as sentiment) s
left join predicted p on p.predicted_sentiment = s.sentiment group by 1""",
    ),
    "monthly_sentiment": with_(
        f"""{PREDICTED},
trend as (select {MONTH} as month, predicted_sentiment, count(*) as comments from predicted group by 1, 2)""",
        "select month, predicted_sentiment, comments, "
        "comments / sum(comments) over (partition by month) as share from trend",
    ),
    "monthly_sentiment_table": with_(
        PREDICTED,
        f"""select {MONTH} as month, count(*) filter (where predicted_sentiment = 'negative') as negative,
  count(*) filter (where predicted_sentiment = 'neutral') as neutral,
  count(*) filter (where predicted_sentiment = 'positive') as positive
from predicted group by 1""",
    ),
    "sentiment_by_score_bucket": with_(
        PREDICTED,
        """select case when comment_score <= -1 then '<-1' when comment_score <= 0 then '-1 to 0'
    when comment_score <= 1 then '1' when comment_score <= 5 then '2-5'
    when comment_score <= 20 then '6-20' else '20+' end as score_bucket,
  count(*) filter (where predicted_sentiment = 'negative') as negative,
  count(*) filter (where predicted_sentiment = 'neutral') as neutral,
  count(*) filter (where predicted_sentiment = 'positive') as positive
from predicted where comment_score > -100 and comment_score <= 1000 group by 1""",
    ),
    "avg_score_by_sentiment": with_(
        PREDICTED,
        "select predicted_sentiment, avg(comment_score) as mean_score, "
        "count(comment_score) as comments from predicted group by 1",
    ),
    "score_spread_by_sentiment": with_(
        PREDICTED,
        "select predicted_sentiment, min(comment_score) as min_score, "
        "max(comment_score) as max_score, avg(comment_score) as mean_score, "
        "cast(median(comment_score) as double) as median_score "
        "from predicted where comment_score is not null group by 1",
    ),
    "avg_post_score_by_sentiment": with_(
        f"{PREDICTED}, {FIRST_SCORES}",
        "select predicted_sentiment, avg(s.score) as mean_post_score, "
        "cast(median(s.score) as double) as median_post_score, "
        "count(s.score) as comments from predicted left join first_scores s using (post_id) "
        "group by 1",
    ),
    "attached_post_scores": with_(
        f"{PREDICTED}, {FIRST_SCORES}",
        "select comment_id, post_id, s.score as post_score "
        "from predicted left join first_scores s using (post_id)",
    ),
    "filter_predictions": with_(
        PREDICTED,
        f"select {_PREDICTION_PREVIEW} from predicted where predicted_sentiment = 'positive' "
        "and list_contains(emotions, 'joy') order by comment_id limit 200",
    ),
    "preview_comments": with_(
        CLEAN,
        "select post_title, comment_body, comment_score, comment_author, comment_length, "
        "post_score, comment_created_at from cleaned order by comment_id limit 200",
    ),
    "sentiment_from_emotions": with_(
        PREDICTED, "select comment_id, predicted_emotions, predicted_sentiment from predicted"
    ),
    "index_labels_to_names": (
        f"select doc_id as id, {strip('text')} as text, "
        f"{EMO}[doc_id % 28 + 1] || '|' || {EMO}[(doc_id * 11 + 3) % 28 + 1] as labels "
        "from documents"
    ),
    "threshold_decode": (
        f"select vec_id, array_to_string([{EMO}[i] for i in range(1, 29) "
        "if coalesce(cast(embedding[i] as double), 0) + coalesce(cast(embedding[i + 28] as double), 0) "
        "+ coalesce(cast(embedding[i + 56] as double), 0) "
        f">= cast({SCORE_THRESHOLD} as double)], '|') as labels "
        "from embeddings"
    ),
    "parse_model_replies": with_(
        f"""{CLEAN},
replies as (
  select comment_id, case doc_id % 10 {REPLIES} end as raw, case doc_id % 10 {LAST_SAID} end as said
  from cleaned
),
inner_part as (
  select *, regexp_extract(raw, {quote(fixed.EMBEDDED_REPLY)}) as emb from replies
),
payloads as (
  select comment_id, raw,
    case when said is not null then cast(said as json)
         when json_valid(trim(raw, chr(10) || ' ')) then cast(trim(raw, chr(10) || ' ') as json)
         when emb <> '' and json_valid(emb) then cast(emb as json) end as payload
  from inner_part
),
answers as (
  select comment_id, raw, case json_type(payload)
      when 'ARRAY' then payload
      when 'OBJECT' then case when json_exists(payload, '$.emotions')
        then json_extract(payload, '$.emotions') else json_extract(payload, '$.labels') end
    end as answer
  from payloads
),
candidates as (
  select comment_id, raw, case json_type(answer)
      when 'VARCHAR' then [answer ->> '$']
      when 'ARRAY' then json_extract_string(answer, '$[*]')
      else cast([] as varchar[]) end as listed
  from answers
),
chosen as (
  select comment_id, case when len(listed) > 0 then listed
      else [e for e in {EMO} if list_contains({words('raw')}, e)] end as names
  from candidates
),
named as (
  select comment_id, lower({strip('name')}) as name, pos from (
    select comment_id, unnest(names) as name, generate_subscripts(names, 1) as pos from chosen
  )
),
kept as (
  select comment_id, name, min(pos) as pos from named
  where name in {in_list(fixed.EMOTIONS)} group by comment_id, name
)""",
        """select c.comment_id, coalesce(string_agg(k.name, '|' order by k.pos), '') as labels
from chosen c left join kept k using (comment_id) group by c.comment_id""",
    ),
    "prompt_and_digest": (
        f"select doc_id, sha256(text) as text_sha256, {PROMPT_HEAD} || text as prompt from documents"
    ),
    "per_label_metrics": with_(
        f"{EVALUATED}, {confusion('judged', EMO)}",
        f"""select label, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as precision,
  case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall,
  {f1('tp', 'fp', 'fn')} as f1, support
from cells where model = 'model_a'""",
    ),
    "weakest_sentiment_labels": with_(
        f"{EVALUATED}, {SENTIMENT_JUDGED}, {confusion('judged3', SENTIMENTS)}",
        f"""select label, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as precision,
  case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall,
  {f1('tp', 'fp', 'fn')} as f1, support
from cells where model = 'model_a'""",
    ),
    "evaluate_emotions": with_(
        f"{EVALUATED}, {confusion('judged', EMO)}, {OVERLAP}",
        """select 'emotions_28' as task, round(macro_f1, 9) as macro_f1, micro_f1, accuracy,
  cast(wrong as double) / (n * 28) as hamming_loss, at_least_one_match,
  round(mean_jaccard, 9) as mean_jaccard
from pooled join setwise using (model) where model = 'model_a'""",
    ),
    "evaluate_sentiment": with_(
        f"{EVALUATED}, {SENTIMENT_JUDGED}, {confusion('judged3', SENTIMENTS)}",
        """select 'sentiment_3' as task, round(macro_f1, 9) as macro_f1, micro_f1,
  (select avg(case when truth = guess then 1.0 else 0.0 end) from judged3 where model = 'model_a')
    as accuracy
from pooled where model = 'model_a'""",
    ),
    "benchmark_summary": summary_of(EVALUATED),
    "benchmark_job": summary_of(
        f"""
judged as (
  select 'roberta_samlowe' as model, 'RoBERTa (SamLowe)' as model_label, doc_id as id,
         {labels(4, False)} as truth, {labels(None, True)} as guess
  from documents where doc_id % 3 = 0
  union all
  select 'bert_monologg', 'BERT (monologg)', doc_id, {labels(4, False)}, {labels(5, True)}
  from documents where doc_id % 3 = 0
)"""
    ),
    "weekly_quota_sample": f"""with placed as (
  select cast(date_diff('day', timestamp '{_START}', date_trunc('day', ts)) // 7 as integer) as week,
         event_id as post_id, event_type as post_hint,
         md5(cast(event_id as varchar) || '{fixed.SEED}') as place
  from events
  where ts >= timestamp '{_START}' and ts < timestamp '{_END}'
    and event_type in {in_list(EVENT_HINTS)}
)
select week, post_id, post_hint from placed
qualify row_number() over (partition by week order by place, post_id)
  <= case when week < {_EXTRA} then {_BASE + 1} else {_BASE} end""",
    "cap_comments_per_post": """with capped as (
  select conv_id, turn, length(text) as n, text from conversations
  qualify row_number() over (partition by conv_id order by length(text) desc, turn) <= 3
)
select p.conv_id as post_id, p.role as post_title, c.turn as comment_id,
  cast(c.n as integer) as comment_score, c.text as comment_body,
  '2024' as period, 'talk' as subreddit
from conversations p join capped c on c.conv_id = p.conv_id where p.turn = 0""",
    "seeded_sample": with_(
        CLEAN,
        f"select nullif(comment_id, '{NO_ID}') as comment_id, comment_body from cleaned "
        f"order by md5(coalesce(nullif(comment_id, '{NO_ID}'), '') || '{fixed.SEED}'), 1 "
        f"limit {SAMPLE}",
    ),
    "scatter_points": with_(
        PREDICTED,
        f"select nullif(comment_id, '{NO_ID}') as comment_id, post_score, predicted_sentiment "
        "from predicted where post_score is not null and predicted_sentiment is not null "
        f"order by md5(coalesce(nullif(comment_id, '{NO_ID}'), '') || '{fixed.SEED}'), 1 "
        f"limit {SAMPLE}",
    ),
    "first_comments": with_(
        CLEAN, f"select comment_id from cleaned order by comment_id limit {SAMPLE}"
    ),
    "score_comments": with_(
        TOY,
        f"""select comment_id, post_id, comment_score, comment_author, comment_created_at,
  post_score, subreddit, array_to_string(emotions, '|') as predicted_emotions,
  {sentiment('emotions')} as predicted_sentiment,
  'roberta_samlowe' as model_key, 'RoBERTa (SamLowe)' as model_label
from scored""",
    ),
    "cached_answers": with_(CACHED, "select text_sha256, copies, cached, labels from answers"),
    "cached_scoring": with_(
        CACHED,
        "select doc_id, labels from documents d join answers a on a.text_sha256 = sha256(d.text)",
    ),
    "keyword_frequencies_custom": with_(
        CLEAN,
        " union all ".join(
            f"""select {quote(label)} as keyword, count(*) filter (where n > 0) as comments_with_keyword,
  cast(sum(n) as bigint) as total_mentions,
  round(count(*) filter (where n > 0) / count(*) * 100, 2) as pct_comments
from (select len(regexp_extract_all(comment_body, {quote(pattern.format(W=W, WS=WS))})) as n from cleaned)"""
            for label, _, pattern in PATTERNS
        ),
    ),
    "cooccurrence_wide": with_(
        PREDICTED,
        "select v.emotion, "
        + ", ".join(
            f"count(h.comment_id) filter (where list_contains(p.emotions, '{e}')) as {e}"
            for e in WIDE
        )
        + f" from (select unnest({EMO + ' || [' + repr('weird') + ']'}) as emotion) v "
        "left join hits h using (emotion) left join predicted p using (comment_id) "
        "group by 1 having count(h.comment_id) > 0",
    ),
    "label_indices": with_(
        PREDICTED,
        f"select comment_id, array_to_string([list_position({EMO}, e) - 1 for e in emotions "
        f"if list_contains({EMO}, e)], '|') as indices from predicted",
    ),
    "example_splits": f"""with examples as (
  select doc_id as id, {strip('text')} as text,
         array_to_string({labels(4, False)}, '|') as labels
  from documents
)
select 'train' as split, * from examples where id % 3 <> 0
union all
select * from (
  select 'test' as split, * from examples where id % 3 = 0
  order by md5(id || '{fixed.SEED}'), id limit {TEST_SAMPLES}
)""",
    "stored_cache": f"""select doc_id,
  case when length({PROMPT_HEAD} || text) % 2 = 0 then 'joy' else 'anger' end as labels,
  (select count(distinct text) from documents) as answers_stored
from documents""",
    "tfidf_weights": f"""with tokens as (
  select doc_id, regexp_extract_all(lower(text), '[{W}]{{2,}}') as t from documents
), grams as (
  select doc_id, unnest(t) as term from tokens
  union all
  select doc_id, unnest([t[i] || ' ' || t[i + 1] for i in range(1, len(t))]) from tokens
), counted as (
  select term, count(distinct doc_id) as df, count(*) as tf from grams group by term
)
select term, df, tf, round(ln(((select count(*) from documents) + 1) / (df + 1)) + 1, 9) as idf
from counted where df >= 2 order by tf desc, term limit {MAX_FEATURES}""",
    "resumed_scoring": with_(
        TOY,
        f"""select {sentiment('emotions')} as predicted_sentiment, 'RoBERTa (SamLowe)' as model_label,
  count(*) as comments, count(*) filter (where len(emotions) = 0) as without_label,
  (select count(distinct comment_body) from cleaned) as texts_scored,
  cast(0 as bigint) as scored_twice
from scored group by all""",
    ),
    "logreg_optimality": """with rows as (
  select quality = 1 as quality, toxic = 1 as toxic, true as every, false as none
  from documents join labels using (doc_id)
), named as (
  select unnest(['quality', 'toxic', 'every', 'none']) as label,
         unnest([quality, toxic, every, none]) as hit from rows
)
select label, count(*) as n, count(*) filter (where hit) as positives,
  count(*) filter (where hit) in (0, count(*)) as constant, true as optimal
from named group by label""",
    "csv_round_trip": with_(RAW, "select * exclude (doc_id, ingest_order) from raw"),
    "predictions_round_trip": with_(
        f"{TOY}, found as (select comment_id, unnest(emotions) as emotion from scored)",
        "select emotion, count(*) as comments, count(*) / (select count(*) from scored) as share "
        "from found group by emotion order by comments desc, emotion limit 28",
    ),
    "run_registry": with_(
        f"{TOY}, {toy_scored('strict', 0.7)}",
        " union all ".join(
            f"select 'run_{key}' as experiment, '{key}' as model_key, '{label}' as model_label, "
            f"count(*) as comments_scored, cast({threshold} as double) as threshold, "
            f"count(*) as rows, max({sentiment('emotions')}) as last_sentiment from {source}"
            for key, label, threshold, source in (
                ("roberta_samlowe", "RoBERTa (SamLowe)", 0.5, "scored"),
                ("bert_monologg", "BERT (monologg)", 0.7, "strict"),
            )
        ),
    ),
}
# Both ways to find the terms that count restate the same thing.
ORACLE["frequent_terms"] = ORACLE["tfidf_weights"]
ORACLE["compacted_cache"] = ORACLE["stored_cache"]
