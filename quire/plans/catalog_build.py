"""More queries with SQL twins: openers, verse and title blocks, feedback, audits, jobs, paths, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import feedback, openers, spine
from quire.plans import dag, duck, paths, service, tables
from quire.plans.catalog import SQL, c, q, query
from quire.plans.tables import DUCK_LOG, DUCK_TURNS

#: Three blocks of each turn, as SQL that both engines read.
_BLOCKS = """select conv_id as book, turn as doc_index, 1 as block_no, case turn % 3 when 0 then 'h1' when 1 then 'p' else 'div' end as tag, case when turn % 3 = 0 then 1 else 0 end as level,
  case when turn % 4 < 2 then substr(text, 1, 24) else coalesce(lag(substr(text, 1, 24)) over (partition by conv_id order by turn), '') end as text, case when length(text) % 3 = 0 then 'embedded-authored-work' else '' end as classes, 0 as images from {t}
 union all select conv_id, turn, 2, 'p', 0, text, case when length(text) % 2 = 0 then 'pre-verse-block' else '' end, length(text) % 2 from {t}
 union all select conv_id, turn, 3, 'p', 0, substr(text, 1, 40), case when length(text) % 4 < 3 then 'indent pre-verse-block' else '' end, 0 from {t}
 union all select conv_id, turn, 4, 'p', 0, substr(text, 1, 12), case when length(text) % 5 < 3 then 'pre-verse-block' else '' end, 0 from {t}"""
DUCK_BLOCKS = "(" + _BLOCKS.format(t="conversations") + ")"
DUCK_DOCS = f"(select t.*, w.current_work, w.current_division from {DUCK_TURNS} t join ({SQL['q_carry_forward']}) w on t.book = w.book and t.doc_index = w.doc_index)"


def _blocks(spark, d):
    return spark.sql(_BLOCKS.replace("{t}", "{rows}"), rows=tables.read(spark, d, "conversations")).withColumn("block_no", c("block_no").cast("long"))


def _docs(spark, d):
    return spine.carry_forward(tables.turns(spark, d))


def _has(name: str) -> str:
    return f"list_contains(string_split(classes, ' '), '{name}')"


_SHOWS = f"({duck.clean('text')} <> '' or images > 0)"
_FIRST = f"(select * from (select *, row_number() over (partition by book, doc_index order by block_no) as k from {DUCK_BLOCKS} where {_SHOWS}) where k = 1)"
_KINDS = ", ".join(map(q, openers.CONTINUED))


@query(f"select book, doc_index, block_no, tag from {_FIRST}")
def q_first_blocks(spark, d):
    return openers.first_blocks(_blocks(spark, d)).select("book", "doc_index", "block_no", "tag")


@query(f"""select b.book, b.doc_index, b.block_no, b.text from {_FIRST} b join {DUCK_DOCS} d on b.book = d.book and b.doc_index = d.doc_index
where b.tag in ('p', 'div') and current_work is not null and d.kind not in ({_KINDS}) and {duck.words('b.text')} <= 10 and {duck.key('b.text')} = {duck.key('current_work')}""")
def q_repeated_titles(spark, d):
    return openers.repeated_titles(_blocks(spark, d), _docs(spark, d))


_TITLED = f"(select *, {duck.display('major_title')} as title from {DUCK_DOCS})"


@query(f"""select book, doc_index, -1 as block_no, 'h1' as tag, title as text, 'major-work formal-opener synthetic-opener' as classes from {_TITLED} d
where title <> '' and kind in ({", ".join(map(q, openers.WORK_KINDS))}) and ({duck.key('current_work')} = '' or {duck.key('current_work')} <> {duck.key('title')})
 and not exists (select 1 from {DUCK_BLOCKS} b where b.book = d.book and b.doc_index = d.doc_index and b.level between 1 and 2 and contains(lower({duck.clean('b.text')}), lower(title)))""")
def q_synthetic_openers(spark, d):
    return openers.synthetic_openers(_blocks(spark, d), _docs(spark, d))


@query(f"""select book, doc_index, -1 as block_no, 'h2' as tag, title as text, 'frontmatter-opener formal-opener synthetic-opener' as classes from {_TITLED} d
where title <> '' and kind = 'frontmatter' and not exists (select 1 from {DUCK_BLOCKS} b where b.book = d.book and b.doc_index = d.doc_index and b.level between 1 and 3 and {duck.key('b.text')} = {duck.key('title')})""")
def q_front_openers(spark, d):
    return openers.front_openers(_blocks(spark, d), _docs(spark, d))


@query(f"""with m as (select *, {_has('pre-verse-block')} as m from {DUCK_BLOCKS}),
r as (select *, sum(case when m and coalesce(before, false) then 0 else 1 end) over (partition by book, doc_index order by block_no) as run from (select *, lag(m) over (partition by book, doc_index order by block_no) as before from m))
select book, doc_index, min(block_no)::bigint as block_no, string_agg(text, chr(10) order by block_no) as text from r group by book, doc_index, run""")
def q_merge_preformatted(spark, d):
    return openers.merge_preformatted(_blocks(spark, d)).select("book", "doc_index", "block_no", "text")


@query(f"""select book, doc_index from (select book, doc_index, row_number() over (partition by book order by doc_index) as k from {_FIRST} where {_has('embedded-authored-work')}) where k > 1""")
def q_embedded_breaks(spark, d):
    return openers.embedded_breaks(_blocks(spark, d))


@query(f"""with c as (select distinct book, {duck.key('heading')} as key from {DUCK_TURNS} where doc_index % 2 = 0),
f as (select book, doc_index, unnest([major_title, current_division]) as t from {DUCK_DOCS} union all
 select book, doc_index, text from (select *, row_number() over (partition by book, doc_index order by block_no) as k from {DUCK_BLOCKS} where level between 1 and 3) where k <= 4 union all
 select book, doc_index, t from (select book, doc_index, string_agg(text, ' ' order by block_no) as t from {DUCK_BLOCKS} group by book, doc_index) where {duck.clean('t')} <> '' and {duck.words('t')} <= 24)
select distinct f.book, f.doc_index from f join c on f.book = c.book and {duck.key('f.t')} = c.key where c.key <> ''""")
def q_matches_contents(spark, d):
    keys = tables.turns(spark, d).where("doc_index % 2 = 0").select("book", text.title_key(c("heading")).alias("key"))
    return openers.matches_contents(_docs(spark, d).withColumn("division", c("current_division")), _blocks(spark, d), keys)


@query(f"""with n as (select book, count(distinct {duck.key('heading')}) as n from {DUCK_TURNS} where doc_index % 2 = 0 group by book)
select d.book, d.doc_index, case when coalesce(n, 0) < 5 and (kind in ('chapter', 'poetry') or {duck.test("coalesce(heading, '')", 'chapter', 'match')}) then 'The Whole Book' else current_work end as current_work from {DUCK_DOCS} d left join n on d.book = n.book""")
def q_forced_work(spark, d):
    contents = tables.turns(spark, d).where("doc_index % 2 = 0").select("book", text.title_key(c("heading")).alias("key"))
    return openers.forced_work(_docs(spark, d), contents, "The Whole [*] Book").select("book", "doc_index", "current_work")


_PIECES = "case when doc_id % 3 = 0 then ['« ', 'T', 'he rest of it'] when doc_id % 3 = 1 then ['word', 's', ' and—', ' x ', 'tail', '(', 'q'] else ['a', 'b'] end"
_PIECES_SPARK = _PIECES.replace("[", "array(").replace("]", ")")


@query(f"""with p as (select doc_id, {_PIECES} as pieces from documents),
a as (select *, list_max(list_transform(range(1, len(pieces) + 1), lambda i: case when i > 1 and regexp_matches(trim(pieces[i]), '^\\p{{L}}$') and regexp_matches(trim(pieces[i - 1]), '[^\\p{{L}}\\p{{N}}]$') then i else 0 end)) as spill from p)
select doc_id, array_to_string(case when spill = 0 then pieces else list_concat(pieces[:spill - 2], [pieces[spill - 1] || trim(pieces[spill])], pieces[spill + 1:]) end, '|') as pieces from a""")
def q_letter_spills(spark, d):
    rows = tables.read(spark, d, "documents").select("doc_id", F.expr(_PIECES_SPARK).alias("pieces"))
    return rows.select("doc_id", F.array_join(openers.merge_letter_spills(c("pieces")), "|").alias("pieces"))


_SIZE = "case p_partkey % 5 when 0 then cast(p_size as {s}) || 'px' when 1 then ' ' || cast(p_size as {s}) || '.50' when 2 then 'auto' when 3 then '' else cast(p_partkey as {s}) || '%' end"
_ALT = "case p_partkey % 4 when 0 then 'IMG_' || cast(p_partkey as {s}) || '.JPG' when 1 then p_name when 2 then 'fig ' || cast(p_size as {s}) || '.png' else '' end"


@query(f"""select p_partkey, try_cast(nullif(regexp_extract(trim({_SIZE.format(s='varchar')}), '^([0-9]+(?:\\.[0-9]+)?)', 1), '') as double) as width,
 case when regexp_matches(lower({_ALT.format(s='varchar')}), {q(openers.IMAGE_FILE)}) then '' else {_ALT.format(s='varchar')} end as alt from part""")
def q_image_attributes(spark, d):
    rows = tables.read(spark, d, "part").select("p_partkey", F.expr(_SIZE.format(s="string")).alias("w"), F.expr(_ALT.format(s="string")).alias("a"))
    return rows.select("p_partkey", openers.image_dimension(c("w")).alias("width"), openers.clear_generic_alt(c("a")).alias("alt"))


# ---------------------------------------------------------------- feedback and audits

_SAYS = "text || case doc_id % 6 when 0 then ' dark page' when 1 then ' Running Head' when 2 then ' toc LEADER' when 3 then ' stage direction' when 4 then ' folio' else '' end"
_HITS = "[" + ", ".join(f"case when regexp_matches(t, {q('(?i)' + words)}) then {q(name)} end" for name, words, _ in feedback.CATEGORIES) + "]"
_FLAGS = "[" + ", ".join(f"case when regexp_matches(t, {q('(?i)' + words)}) then {q(flag)} end" for _, words, flag in feedback.CATEGORIES) + "]"


def _reports(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", F.expr(_SAYS).alias("t"))


@query(f"select doc_id, array_to_string(list_filter({_HITS}, lambda x: x is not null), ',') as categories from (select doc_id, coalesce({_SAYS}, '') as t from documents)")
def q_visual_categories(spark, d):
    return _reports(spark, d).select("doc_id", F.array_join(feedback.categories(c("t")), ",").alias("categories"))


_HELD = f"case when doc_id % 2 = 0 then [{q(feedback.CATEGORIES[4][2])}] else [] end"


@query(f"""select doc_id, array_to_string(list_concat(held, list_filter(new, lambda x: x is not null and not list_contains(held, x))), chr(10)) || chr(10) || 'line' as feedback,
 coalesce(regexp_matches(array_to_string(list_concat(held, new), chr(10)), '(?i)folio'), false) as folio from (select doc_id, {_FLAGS} as new, {_HELD} as held from (select doc_id, coalesce({_SAYS}, '') as t from documents))""")
def q_feedback_text(spark, d):
    held = F.when(c("doc_id") % 2 == 0, F.array(F.lit(feedback.CATEGORIES[4][2]))).otherwise(F.array().cast("array<string>"))
    both = feedback.add_flags(held, feedback.flags(c("t")))
    return _reports(spark, d).select("doc_id", F.concat_ws("\n", F.when(F.size(both) == 0, "").otherwise(feedback.feedback_text(both)), F.lit("line")).alias("feedback"), feedback.speaks_of("folio", both).alias("folio"))


def _audit(spark, d):
    return tables.read(spark, d, "events").select(c("event_type").alias("channel"), c("props").alias("message"), "event_id")


@query("select a.channel, a.n - coalesce(b.n, 0) as n from (select event_type as channel, count(*) as n from events group by 1) a left join (select event_type as channel, count(*) as n from events where event_id % 3 = 0 group by 1) b using (channel) where a.n > coalesce(b.n, 0)")
def q_audit_delta(spark, d):
    rows = _audit(spark, d)
    return feedback.delta(feedback.snapshot(rows.where("event_id % 3 = 0")), feedback.snapshot(rows))


@query("select event_type as channel, (count(*) + count(*) filter (where event_id % 3 = 1))::bigint as n from events group by 1")
def q_audit_replay(spark, d):
    rows = _audit(spark, d)
    return feedback.replay(feedback.snapshot(rows), feedback.snapshot(rows.where("event_id % 3 = 1")))


# ---------------------------------------------------------------- jobs, paths, keys

_OUT = "case p_partkey % 3 when 0 then p_name || '.v2.pdf' when 1 then 'sub dir/' || p_name || '.pdf' else 'plain' end"
_PDF = f"(case when contains({_OUT}, '/') then {_OUT} else 'out/' || {_OUT} end)"
_STEM = r"regexp_replace(regexp_extract(pdf, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1')"


@query(f"select p_partkey, pdf, 'work/' || {duck.slug(_STEM, 'run')} as artifacts from (select p_partkey, {_PDF} as pdf from part)")
def q_output_paths(spark, d):
    rows = tables.read(spark, d, "part").select("p_partkey", paths.output_pdf(F.expr(_OUT), F.lit("out")).alias("pdf"))
    return rows.select("p_partkey", "pdf", paths.artifact_dir(F.lit("work"), c("pdf")).alias("artifacts"))


_MODE = "case user_id % 4 when 0 then 'Simple ' when 1 then 'HIERARCHICAL' when 2 then 'auto' end"


@query(f"select distinct user_id, case when lower(trim({_MODE})) in ('simple', 'hierarchical') then lower(trim({_MODE})) else 'simple' end as mode from events")
def q_toc_mode(spark, d):
    return tables.read(spark, d, "events").select("user_id", paths.toc_mode(F.expr(_MODE)).alias("mode")).distinct()


_UPLOAD = "case page_id % 4 when 0 then '..' || replace(url, 'https://', 'a b ') when 1 then url || 'my book (1).EPUB' when 2 then '/x/_._' else url end"
_SAFE = r"regexp_replace(regexp_replace(regexp_extract(u, '([^/]*)$', 1), '[^\w.\-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g')"


@query(f"select page_id, case when ends_with(lower(s), '.epub') then s else s || '.epub' end as upload from (select page_id, coalesce(nullif({_SAFE}, ''), 'book.epub') as s from (select page_id, {_UPLOAD} as u from pages))")
def q_upload_names(spark, d):
    return tables.read(spark, d, "pages").select("page_id", service.upload_name(F.expr(_UPLOAD)).alias("upload"))


@query(f"""with m as (select user_id as job_id, min(event_id)::double as created from events where event_id % 2 = 0 group by 1), p as ({SQL['q_job_progress'].replace(DUCK_LOG, f"(select * from {DUCK_LOG} where seq % 3 = 0)")}),
o as (select distinct user_id as job_id, case when user_id % 2 = 0 then 'done' else 'failed' end as status from events where user_id % 5 < 2)
select m.job_id, row_number() over (order by created desc, m.job_id)::int as place, coalesce(o.status, case when p.lines > 0 then 'running' else 'queued' end) as status, coalesce(progress, 0.0)::double as progress, stage, coalesce(lines, 0)::bigint as lines
from m left join p on m.job_id = p.job_id left join o on m.job_id = o.job_id""")
def q_job_list(spark, d):
    events = tables.read(spark, d, "events")
    made = events.where("event_id % 2 = 0").groupBy(c("user_id").alias("job_id")).agg(F.min("event_id").cast("double").alias("created"))
    outcomes = events.where("user_id % 5 < 2").select(c("user_id").alias("job_id"), F.when(c("user_id") % 2 == 0, "done").otherwise("failed").alias("status")).distinct()
    return service.listing(made, tables.log(spark, d).where("seq % 3 = 0"), outcomes).select("job_id", "place", "status", "progress", "stage", "lines")


_OPTIONS = {"title": "source", "book_title": "lang", "rule_packs": "lang", "use_openai": "case when doc_id % 2 = 0 then true else false end", "settings": "source", "image_policy": "lang"}


def _t(x: str) -> str:
    return f"sha256(coalesce({x}, ''))"


def _j(*parts: str) -> str:
    return "sha256(" + " || '|' || ".join(f"coalesce({p}, '')" for p in parts) + ")"


def _keys_sql() -> str:
    o = lambda n: _t(f"cast({_OPTIONS[n]} as varchar)") if n in _OPTIONS else _t("''")
    scan = _j("file", o("rule_packs"), _t(q(dag.SCAN_VERSION)))
    review = f"case when doc_id % 2 = 0 then {_j('scan', o('ai_provider'), o('openai_model'), o('deepseek_model'), o('book_title'))} end"
    fonts = _j(*(o(n) for n in ("embed_font_files", "font_dir", "embedded_font_regular", "embedded_font_italic")))
    clean = _j("scan", "review", *(o(n) for n in ("image_policy", "smart_punctuation", "footnote_handling", "rule_packs", "title", "major_opener_blank_before", "major_opener_blank_after")), _t(q(dag.CLEAN_VERSION)))
    return f"""with f as (select doc_id, source, lang, {_t('text')} as file from documents), s as (select *, {scan} as scan from f), r as (select *, {review} as review from s), k as (select *, {clean} as clean, {fonts} as fonts from r),
p as (select *, {_j('clean', 'fonts', o('settings'))} as composed from k)
select doc_id, {_j('file', o('title'))} as resolve_title, {_j('file', o('book_title'))} as read_assets, scan as scan_classify, review as ai_plan, fonts as prepare_fonts, clean as clean_documents, composed as compose_render, {_j('composed', o('runner_font_pt'), o('runner_body_clearance_mm'))} as qa from p"""


@query(_keys_sql())
def q_stage_keys(spark, d):
    rows = tables.read(spark, d, "documents")
    option = lambda n: F.expr(_OPTIONS[n]) if n in _OPTIONS else F.lit("")
    keys = dag.stage_keys(F.sha2(F.coalesce("text", F.lit("")), 256), option)
    return rows.select("doc_id", *(k.alias(n) for n, k in keys.items()))
