"""The engine's queries over the stored tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import patterns, text
from quire.operators import blocks, compose, headings, identity, preflight, quality, spine, toc
from quire.plans import build, dag, duck, jobs, settings, tables
from quire.plans.tables import DUCK_LAID_OUT, DUCK_LINES, DUCK_LOG, DUCK_TURNS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


c, q = F.col, duck.q


def _split_select(items: str) -> list[str]:
    """The expressions of a select list, parted at commas outside of parentheses."""
    out, depth = [""], 0
    for ch in items:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


SO_FAR = "(partition by book order by doc_index rows between unbounded preceding and 1 preceding)"

# ---------------------------------------------------------------- scalar functions


@query(f"select doc_id, {duck.clean('text')} as cleaned from documents")
def q_clean_text(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", text.clean_text(c("text")).alias("cleaned"))


@query(f"select lang, count(*) as docs, sum({duck.words('text')})::bigint as words from documents group by lang")
def q_word_count_by_lang(spark, d):
    return tables.read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(text.word_count(c("text"))).alias("words"))


@query(f"select doc_id, round({duck.ratio('text')}, 6) as upper_ratio from documents")
def q_upper_ratio(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", F.round(text.letter_ratio(c("text")), 6).alias("upper_ratio"))


@query(f"select p_partkey, {duck.slug('p_name')} as slug from part")
def q_slugify(spark, d):
    return tables.read(spark, d, "part").select("p_partkey", text.slugify(c("p_name")).alias("slug"))


@query(f"""with s as (select p_partkey, {duck.slug("p_name", "book")} as slug, p_name from part)
select p_partkey, slug || case when n > 1 then '-' || n else '' end || '.pdf' as output
from (select *, row_number() over (partition by slug order by lower(p_name || '/' || lpad(p_partkey::varchar, 9, '0'))) as n from s)""")
def q_batch_names(spark, d):
    part = tables.read(spark, d, "part").select("p_partkey", c("p_name").alias("stem"), F.concat("p_name", F.lit("/"), F.lpad(c("p_partkey").cast("string"), 9, "0")).alias("path"))
    return identity.batch_names(part).select("p_partkey", "output")


@query(f"select lang, key, min(doc_id) as first_doc, count(*) as n from (select doc_id, lang, {duck.key('text')} as key from documents) where key <> '' group by lang, key")
def q_title_key_dedup(spark, d):
    rows = tables.read(spark, d, "documents").select("doc_id", "lang", text.title_key(c("text")).alias("key")).where("key <> ''")
    return rows.groupBy("lang", "key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


_STARRED = f"{duck.clean('p_name')} || case when p_partkey % 3 = 0 then ' [**] ' else '' end"


@query(f"select p_partkey, {duck.display(_STARRED)} as title from part")
def q_display_title(spark, d):
    starred = F.concat(text.clean_text(c("p_name")), F.when(c("p_partkey") % 3 == 0, " [**] ").otherwise(""))
    return tables.read(spark, d, "part").select("p_partkey", text.display_title(starred).alias("title"))


_MIXED = "case p_partkey % 3 when 0 then upper(p_name) when 1 then upper(substr(p_name, 1, 8)) || substr(p_name, 9) else replace(p_name, ' ', '--') end"


@query(f"select p_partkey, {duck.title_case('t')} as title from (select p_partkey, {_MIXED} as t from part)")
def q_toc_title_case(spark, d):
    return tables.read(spark, d, "part").selectExpr("p_partkey", f"{_MIXED} as t").select("p_partkey", text.title_case(c("t")).alias("title"))


_NAMED = "case p_partkey % 6 when 0 then replace(p_name, ' ', ', ') when 1 then 'Sir ' || p_name when 2 then p_name || ', Leo, Graf., Arthur' when 3 then ' ; ' || p_name || ' ,' when 4 then 'Count' else 'Lady, Dame' end"


def _noble(w: str) -> str:
    return f"regexp_replace(lower({w}), '^\\.+|\\.+$', '', 'g') in ({', '.join(map(q, text.NOBLE))})"


@query(f"""with b as (select p_partkey, regexp_replace({duck.clean(_NAMED)}, '^[ ,;]+|[ ,;]+$', '', 'g') as bare from part),
p as (select *, list_filter(list_transform(string_split(bare, ','), lambda x: trim(x)), lambda x: x <> '') as parts from b),
w as (select p_partkey, list_filter(string_split({duck.clean(f"case when len(parts) >= 2 then array_to_string(list_concat(parts[2:2], list_filter(parts[3:], lambda x: not ({_noble('x')})), parts[1:1]), ' ') else bare end")}, ' '), lambda x: x <> '') as ws from p)
select p_partkey, array_to_string(ws[coalesce(nullif(list_position(list_transform(ws, lambda x: {_noble('x')}), false), 0), len(ws)):], ' ') as author from w""")
def q_author_names(spark, d):
    return tables.read(spark, d, "part").select("p_partkey", text.author_name(F.expr(_NAMED)).alias("author"))


_TRIMS = [("A5 landscape", 595.28, 419.53, "A5 landscape"), ("A4", 595.28, 841.89, "A4"), ("letter", 612.0, 792.0, "letter"), ("6in x 9in", 432.0, 648.0, "6in x 9in"), ("10cm 20cm", 283.46, 566.93, "10cm 20cm"), ("what", 595.28, 841.89, "A4"), ("legal portrait", 612.0, 1008.0, "legal portrait"), ("", 595.28, 841.89, "A4")]


@query(f"select * from {duck.values(_TRIMS, 'trim_size, width, height, label')}")
def q_trim_sizes(spark, d):
    rows = spark.createDataFrame([(a[0],) for a in _TRIMS], "trim_size string").withColumn("s", text.trim_size(c("trim_size")))
    return rows.select("trim_size", F.round("s.width", 2).alias("width"), F.round("s.height", 2).alias("height"), c("s.label").alias("label"))


_LENGTHS = ["12mm", "2.5cm", "1in", "10", "7.5pt", "x", "", " 3IN ", "1e3mm", "5 mm"]


@query(f"select s, round({duck.points('s')}, 6) as points from {duck.values([(x,) for x in _LENGTHS], 's')}")
def q_css_lengths(spark, d):
    return spark.createDataFrame([(x,) for x in _LENGTHS], "s string").select("s", F.round(text.css_points(c("s")), 6).alias("points"))


_COLOR = "case p_partkey % 5 when 0 then '#' || {h} when 1 then substr({h}, 1, 3) when 2 then '#' || substr({h}, 1, 5) when 3 then ' ##' || {h} || ' ' else 'g' || substr({h}, 1, 5) end"
_HEX = "(case when regexp_matches(s, '^[0-9A-Fa-f]{{6}}$') then ('0x' || substr(s, {k}, 2))::bigint / 255.0 else 0.0 end)"
_LONG = "(select p_partkey, case when length(s) = 3 then regexp_replace(s, '(.)', '\\1\\1', 'g') else s end as s from (select p_partkey, regexp_replace(trim(" + _COLOR.format(h="printf('%06x', p_partkey * 7919 % 16777216)") + "), '^#+', '') as s from part))"


@query(f"select p_partkey, round({_HEX.format(k=1)}, 6)::double as r, round({_HEX.format(k=3)}, 6)::double as g, round({_HEX.format(k=5)}, 6)::double as b from {_LONG}")
def q_hex_color(spark, d):
    rows = tables.read(spark, d, "part").select("p_partkey", text.hex_color(F.expr(_COLOR.format(h="format_string('%06x', p_partkey * 7919 % 16777216)"))).alias("x"))
    return rows.select("p_partkey", *(F.round(f"x.{k}", 6).alias(k) for k in "rgb"))


_SRCS = [("../img/a%20b.png#x", "text/ch1.html", "img/a b.png"), ("a+b.png", "ch.html", "a+b.png"), ("", "x/y.html", ""), ("./c/../d.jpg", "x/y.html", "x/d.jpg"), ("/abs/e.png", "x/y.html", "/abs/e.png"), ("../../f.png", "x/y.html", "../f.png")]


@query(f"select * from {duck.values(_SRCS, 'src, doc, path')}")
def q_image_paths(spark, d):
    rows = spark.createDataFrame([x[:2] for x in _SRCS], "src string, doc string")
    return rows.select("src", "doc", text.resolve_src(c("src"), c("doc")).alias("path"))


@query("select doc_id, case when n_chars % 60 <= 0 then 0 else greatest(6000, n_chars % 60 * 700) end::bigint as budget from documents")
def q_sample_words(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", text.sample_budget(c("n_chars") % 60).alias("budget"))


# ---------------------------------------------------------------- pages: probe and kinds

_H = f"regexp_replace(coalesce(html, ''), {q(spine.DROP)}, '', 'g')"


def _flat(x: str) -> str:
    return duck.clean(duck.unescape(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"))


DUCK_PROBE = f"""(select page_id // 10 as book, page_id % 10 as doc_index, url as name, lower(regexp_extract(h, {q(spine.HEADING)}, 1)) as tag,
 coalesce(hs[1], '') as heading, len(hs)::bigint as n_headings, len(list_filter(hs, lambda t: {duck.found('t', spine.LICENSE_HEADING)}))::bigint as license_headings,
 text, length(text)::bigint as n_chars, {duck.words('text')} as n_words, {duck.count('lower(h)', '<a[ >]')}::bigint as links, {duck.count('lower(h)', '<img[ >/]')}::bigint as images,
 regexp_matches(array_to_string(list_transform(list_transform(ps[1:200], lambda p: {_flat("'<p>' || p")}), lambda t: case when t = '' then '' when length(t) between 2 and 64 and not ends_with(t, '.') then 's' else 'x' end), ''), 's{{6}}')
  or {duck.test("array_to_string(classes, ' ')", 'poetry_class')}
  or len(list_filter(ps, lambda p: {duck.count('lower(p)', '<br')} >= 2 and length({_flat('p')}) < 1600)) + len(list_filter(divs, lambda p: {duck.count('lower(p)', '<br[^a-z0-9]')} >= 2 and length({_flat('p')}) < 1600)) >= 2 as poetry,
 len(list_filter(hs, lambda t: {duck.test('t', 'cast', 'match')})) > 0 as drama
 from (select *, list_transform(regexp_extract_all(h, '(?s)<[a-zA-Z][^>]*>')[1:500], lambda t: regexp_extract(t, {q(spine.CLASS)}, 1)) as classes,
  list_transform(list_filter(range(2, len(parts) + 1), lambda i: starts_with(parts[i], '<div')), lambda i: array_to_string(parts[i:coalesce(list_filter(range(i + 1, len(parts) + 1), lambda j: depths[j] < depths[i])[1] - 1, len(parts))], '')) as divs, list_filter(list_transform(regexp_extract_all(h, {q(spine.HEADING)}, 2), lambda x: {_flat('x')}), lambda t: t <> '') as hs,
  list_transform(string_split_regex(h, '(?i)<p[ >]')[2:], lambda p: string_split(p, '</p>')[1]) as ps, {_flat('h')} as text
  from (select *, list_transform(range(1, len(parts) + 1), lambda i: coalesce(list_sum(list_transform(parts[2:i], lambda x: case when starts_with(x, '<div') then 1 else -1 end)), 0)) as depths
   from (select *, string_split(regexp_replace(h, '(?i)<(/?)div([^a-z0-9])', chr(1) || '<\\1div\\2', 'g'), chr(1)) as parts from (select page_id, url, {_H} as h from pages)))))"""


@query(f"select book, doc_index, tag, heading, n_headings, n_chars, n_words, links, images, poetry, drama from {DUCK_PROBE}")
def q_html_probe(spark, d):
    return tables.probed(spark, d).select("book", "doc_index", "tag", "heading", "n_headings", "n_chars", "n_words", "links", "images", "poetry", "drama")


@query(f"select book, doc_index, text from {DUCK_PROBE}")
def q_html_text(spark, d):
    return tables.probed(spark, d).select("book", "doc_index", "text")


@query()
def q_heading_list(spark, d):
    return spine.heading_list(tables.read(spark, d, "pages"))


def _ladder() -> str:
    """classify() in SQL."""
    f, t = duck.found, duck.test
    whole = "lower(bare) || ' ' || substr(low, 1, 2500)"
    hits = " + ".join(f"{f('whole', p)}::int" for p in spine.PUBLISHER)
    listing = " + ".join(f"contains(low, {q(p)})::int" for p in spine.LISTING)
    phrase = " or ".join(f"contains(low, {q(p)})" for p in spine.GALLERY_PHRASES)
    front = " or ".join(f"contains(low, {q(w)})" for w in spine.FRONT_WORDS)
    blob = f"(n_chars <= 6000 and contains(low, 'contents') and contains(low, 'version 1') and (contains(low, 'the biographies') or contains(low, 'the essays')) and {f('sample', spine.COLLECTION_TITLE)} and ({listing}) >= 3)"
    short = f("bare", spine.SHORT_CONTENTS_HEADING)
    return f"""(with p as (select *, substr(text, 1, {spine.SAMPLE}) as sample, regexp_replace(heading, '^[ .]+|[ .]+$', '', 'g') as bare from {DUCK_PROBE}),
 p2 as (select *, lower(sample) as low, heading || ' ' || substr(sample, 1, 1200) as start from p),
 p3 as (select *, {whole} as whole from p2),
 r as (select *, case when {f('bare', spine.CONTENTS_HEADING)} or ({short} and n_chars < 12000) or (not {short} and ({f('substr(sample, 1, 500)', spine.CONTENTS_LEAD)} or {blob})) then 'contents'
  when doc_index <= 20 and n_chars <= 1800 and ({f('bare', '^the' + chr(92) + 's+books$')} or {f('low', spine.GALLERY)}) and (images > 0 or {phrase}) then 'gallery'
  when {f('bare', spine.CATALOGUE_HEADING)} or (n_chars < 20000 and (({hits}) >= 2 or {f('whole', spine.PUBLISHER_PHRASE)})) then 'publisher'
  when {f('start', spine.WRAPPER[0])} and {f('start', spine.WRAPPER[1])} and n_chars < 5000 then 'wrapper'
  when {f('start', spine.LICENSE)} and n_chars < 8000 then 'license'
  when {f('start', spine.LICENSE)} and n_headings > 0 and license_headings = n_headings then 'license-only' end as rule,
  {t('sample', 'promo')} and n_chars < 3500 as promo, {t('heading', 'local_toc', 'match')} and {duck.count('sample', ' ')} < 800 as toc,
  case when {t('heading', 'frontmatter', 'match')} then 'frontmatter' when {t('heading', 'backmatter', 'match')} then 'backmatter' when {t('heading', 'divisions', 'match')} then 'division'
   when {t('heading', 'cast', 'match')} or drama then 'play' when poetry then 'poetry'
   when heading <> '' and not {t('heading', 'chapter', 'match')} and not {t('heading', 'promo')} and tag = 'h1' and length(heading) < 100 then 'major_work' end as by_heading,
  ({front}) and doc_index < 5 as front from p3)
 select book, doc_index, heading, n_words, n_chars, n_headings, images, rule,
  case when rule = 'contents' then 'local_toc' when rule is not null then 'promo' else coalesce(by_heading, case when toc then 'local_toc' when promo then 'promo' when front then 'frontmatter' else 'chapter' end) end as kind,
  case when rule is not null then true when by_heading in ('play', 'poetry') then false else promo or toc end as remove,
  case rule when 'contents' then 0.9 when 'gallery' then 0.88 when 'publisher' then 0.94 when 'wrapper' then 0.96 when 'license' then 0.95 when 'license-only' then 0.92 else case when toc then 0.8 when promo then 0.78 else 0.0 end end::double as confidence,
  case when rule is null and by_heading in ('frontmatter', 'backmatter', 'division', 'major_work') then heading end as major_title from r)"""


DUCK_KINDS = _ladder()


@query(f"select book, doc_index, rule, kind, remove, confidence, major_title from {DUCK_KINDS}")
def q_classify(spark, d):
    return spine.classify(tables.probed(spark, d)).select("book", "doc_index", "rule", "kind", "remove", "confidence", "major_title")


@query(f"select kind, remove, count(*) as docs, sum(n_words)::bigint as words from {DUCK_KINDS} group by kind, remove")
def q_kind_histogram(spark, d):
    return spine.classify(tables.probed(spark, d)).groupBy("kind", "remove").agg(F.count("*").alias("docs"), F.sum("n_words").alias("words"))


_DOC_HITS = " + ".join(f"{duck.found('substr(lower(text), 1, 2500)', p)}::int" for p in spine.PUBLISHER)


@query(f"select doc_id, ({_DOC_HITS})::int as hits from documents")
def q_publisher_score(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", spine.apparatus_hits(F.lit(""), c("text")).alias("hits"))


# ---------------------------------------------------------------- ordered passes


@query(f"""select book, doc_index, case when late then 'chapter' else kind end as kind, late from (select *, not remove and kind = 'frontmatter' and
 coalesce(max(case when not remove and kind in ('major_work', 'play', 'poetry', 'backmatter') then 1 else 0 end) over {SO_FAR}, 0) = 1 as late from {DUCK_TURNS})""")
def q_demote_frontmatter(spark, d):
    return spine.demote_late_frontmatter(tables.turns(spark, d)).select("book", "doc_index", "kind", "late")


@query(f"""with a as (select *, not remove and kind = 'major_work' as real, remove and coalesce(rule = 'gallery', false) as gallery from {DUCK_TURNS}),
b as (select *, not real and doc_index <= 25 and images > 0 and n_headings = 0 and n_chars < 350 as candidate from a),
e as (select *, candidate and coalesce(last_value(case when not candidate or gallery then gallery end ignore nulls) over {SO_FAR}, false) and coalesce(max(real::int) over {SO_FAR}, 0) = 0 as orphan from b)
select book, doc_index, case when orphan then 'promo' else kind end as kind, remove or orphan as remove, orphan from e""")
def q_orphan_media(spark, d):
    return spine.drop_orphan_media(tables.turns(spark, d)).select("book", "doc_index", "kind", "remove", "orphan")


@query(f"""select book, doc_index, last_value(case when not remove and kind in ('division', 'major_work', 'backmatter') then t end ignore nulls) over {SO_FAR} as current_work,
 last_value(case when not remove and kind = 'division' then t end ignore nulls) over {SO_FAR} as current_division from (select *, nullif({duck.display('major_title')}, '') as t from {DUCK_TURNS})""")
def q_carry_forward(spark, d):
    return spine.carry_forward(tables.turns(spark, d)).select("book", "doc_index", "current_work", "current_division")


@query(f"""with a as (select *, {duck.key('heading')} as k from {DUCK_TURNS}),
w as (select k from (select k, min(book) as b, count(*) as n from a where kind in ('division', 'major_work', 'backmatter') and k <> '' group by k) order by n desc, k limit 1),
s as (select book, min(doc_index) as start from a where kind in ('division', 'major_work', 'backmatter') and k = (select k from w) group by book),
e as (select a.book, s.start, min(case when a.doc_index > s.start and (a.kind = 'division' or (x.kind <> 'division' and a.kind in ('major_work', 'backmatter'))) then a.doc_index end) as stop
 from s join a using (book) join a x on x.book = s.book and x.doc_index = s.start group by a.book, s.start)
select a.book, a.doc_index, a.kind from a join e on a.book = e.book and a.doc_index >= e.start and (e.stop is null or a.doc_index < e.stop)""")
def q_section_subset(spark, d):
    turns = tables.turns(spark, d)
    keyed = turns.where(c("kind").isin(*spine.BOUNDARY_KINDS)).select(text.title_key(c("heading")).alias("k")).where("k <> ''")
    best = keyed.groupBy("k").count().orderBy(F.desc("count"), "k").limit(1).collect()
    return spine.section(turns, best[0].k if best else "").select("book", "doc_index", "kind")


@query(f"""select book, doc_index, n_words, words_before from (select *, coalesce(sum(case when not remove then n_words end) over {SO_FAR}, 0)::bigint as words_before from {DUCK_TURNS})
where not remove and words_before < 100""")
def q_sample_budget(spark, d):
    return spine.within_budget(tables.turns(spark, d), 100).select("book", "doc_index", "n_words", "words_before")


@query("""select d.doc_id, case when l.quality = 1 then 'major_work' when l.quality = 0 then 'promo' else 'chapter' end as kind,
 case when l.doc_id is not null then l.toxic = 1 and (d.doc_id % 100) / 100.0 >= 0.86 else d.doc_id % 2 = 0 end as remove from documents d left join labels l on d.doc_id = l.doc_id""")
def q_ai_overrides(spark, d):
    docs = tables.read(spark, d, "documents").select(F.lit(0).alias("book"), c("doc_id").alias("doc_index"), F.lit("chapter").alias("kind"), (c("doc_id") % 2 == 0).alias("remove"))
    made = tables.read(spark, d, "labels").select(F.lit(0).alias("book"), c("doc_id").alias("doc_index"), F.when(c("quality") == 1, "major_work").otherwise("promo").alias("kind"), (c("toxic") == 1).alias("remove"), ((c("doc_id") % 100) / 100.0).alias("confidence"))
    return spine.override(docs, made).select(c("doc_index").alias("doc_id"), "kind", "remove")


# ---------------------------------------------------------------- lines and blocks


@query(f"select book, line_no, text from {DUCK_LINES} where {duck.test('text', 'promo')} and length(text) < 360 and {duck.found('lower(text)', blocks.STRONG_PROMO)}")
def q_promo_lines(spark, d):
    return tables.lines(spark, d).where(blocks.promotional(c("text"), F.lit(""), F.lit(0))).select("book", "line_no", "text")


@query(f"select page_id % 7 as slot, 'promo: ' || substr(t, 1, 220) as sample from (select page_id, {_flat('html')} as t from pages) where {duck.test('t', 'promo')}")
def q_promo_audit(spark, d):
    rows = tables.read(spark, d, "pages").select("page_id", spine.flat_text(c("html")).alias("t")).where(patterns.test(c("t"), "promo"))
    return rows.select((c("page_id") % 7).alias("slot"), F.concat(F.lit("promo: "), F.substring("t", 1, 220)).alias("sample"))


_SHORT = f"length(text) between 2 and 76 and not ends_with(text, '.') and not {duck.test('text', 'chapter', 'match')}"


@query(f"""with a as (select *, {_SHORT} as m from {DUCK_LINES}), b as (select *, sum(case when m then 0 else 1 end) over (partition by book order by line_no) as island from a)
select book, min(line_no) as first_line, count(*) as n, string_agg(text, chr(10) order by line_no) as text from b where m group by book, island having count(*) >= 4""")
def q_verse_sequences(spark, d):
    return blocks.verse_runs(tables.lines(spark, d))


@query(f"""with a as (select *, length(text) between 2 and 64 and not ends_with(text, '.') as m from {DUCK_LINES} where text <> ''), b as (select *, sum(case when m then 0 else 1 end) over (partition by book order by line_no) as island from a)
select book, max(n)::bigint as longest from (select book, island, count(*) as n from b where m group by book, island) group by book having max(n) >= 6""")
def q_poetry_runs(spark, d):
    t = c("text")
    runs = blocks.islands(tables.lines(spark, d).where("text <> ''"), F.length(t).between(2, 64) & ~F.endswith(t, F.lit("."))).groupBy("book", "island").count()
    return runs.groupBy("book").agg(F.max("count").alias("longest")).where("longest >= 6")


_NOTES = "case when line_no % 5 < 2 then '[' || line_no || '] ' || text else text end"


@query(f"""with a as (select book, line_no, {_NOTES} as text from {DUCK_LINES}), b as (select *, regexp_matches(text, '^\\[[0-9]+\\]\\.?\\s+') as m from a),
e as (select *, sum(case when m then 0 else 1 end) over (partition by book order by line_no) as island from b), f as (select *, count(*) over (partition by book, island) as n, min(line_no) over (partition by book, island) as cluster from e where m)
select book, cluster, regexp_extract(text, '^\\[([0-9]+)\\]', 1) as number, 'fn-' || regexp_extract(text, '^\\[([0-9]+)\\]', 1) as note_id, regexp_replace(text, '^\\[[0-9]+\\]\\.?\\s+', '') as note from f where n >= 2""")
def q_footnote_clusters(spark, d):
    return blocks.footnote_clusters(tables.lines(spark, d).selectExpr("book", "line_no", f"{_NOTES.replace('line_no ||', 'cast(line_no as string) ||')} as text"))


_BRACKET = "case when line_no % 7 = 0 then '[' || text || ']' when line_no % 11 = 0 then '(' || text || ')' else text end"


@query(f"select book, line_no, text from (select book, line_no, {_BRACKET} as text from {DUCK_LINES}) where regexp_matches(text, '^\\[.*\\]$|^\\(.*\\)$') and length(text) < 240")
def q_stage_directions(spark, d):
    return blocks.stage_directions(tables.lines(spark, d).selectExpr("book", "line_no", f"{_BRACKET} as text"))


_RAW = "case line_no % 5 when 0 then replace(text, ' ', '--') when 1 then replace(text, ' ', '  -- ') when 2 then replace(text, ' ', '... ') when 3 then replace(text, ' ', ' b.c. ') else 'At 5 A.M. ' || replace(text, ' ', ', BCE; ') end"
_TYPED = f"regexp_replace(replace(regexp_replace({_RAW}, '[ ]+', ' ', 'g'), '...', '…'), '\\s+--\\s+', ' — ', 'g')"
for _ in range(2):
    _TYPED = f"regexp_replace({_TYPED}, '([{text.W}])--([{text.W}])', '\\1—\\2', 'g')"
_ABBREVIATED = "[Aa]\\.?[Mm]|[Pp]\\.?[Mm]|[Bb]\\.?[Cc]|[Aa]\\.?[Dd]|[Bb][Cc][Ee]|[Cc][Ee]|[Nn]\\.?[Bb]|[Pp]\\.?[Ss]"


@query(f"select book, line_no, {_TYPED} as fixed from {DUCK_LINES}")
def q_typography(spark, d):
    return tables.lines(spark, d).select("book", "line_no", text.typography(F.expr(_RAW)).alias("fixed"))


@query(f"""select book, line_no, regexp_replace({_RAW}, '(^|[^{text.W}])({_ABBREVIATED})([\\s.,;:])', '\\1<span class="small-caps">\\2</span>\\3', 'g') as marked from {DUCK_LINES}""")
def q_small_caps(spark, d):
    return tables.lines(spark, d).select("book", "line_no", text.small_caps(F.expr(_RAW)).alias("marked"))


_PICTURE = """p_partkey, case p_partkey % 7 when 0 then 'keep-all' when 1 then 'remove-all' else 'functional' end as policy, case p_partkey % 11 when 10 then 'IMG_1.jpg' else '' end as alt,
 case p_partkey % 5 when 0 then 'art/map' when 1 then 'img_' when 2 then 'x' when 3 then 'frontispiece' else 'photo' end || case when p_partkey % 5 = 3 then '' else cast(p_size as {s}) end || '.png' as src,
 case p_size % 4 when 0 then '' when 1 then 'the map' when 2 then 'a dog' else 'portrait of a man' end as context, case when p_partkey % 3 = 0 then p_size * 20.0 end as width, case when p_partkey % 3 = 0 then p_size * 9.0 end as height,
 p_partkey % 2 = 0 as standalone, case when p_size % 3 < 2 then p_size % 3 = 0 end as decision, case when p_size % 3 < 2 then (p_partkey % 10) / 10.0 end as confidence"""
_GENERIC = f"(regexp_matches(regexp_extract({duck.clean('alt')}, '([^/]*)$', 1), {q('(?i)' + blocks.IMAGE_FILE)}) or regexp_matches(regexp_extract({duck.clean('src')}, '([^/]*)$', 1), {q('(?i)' + blocks.IMAGE_FILE)}))"
_BESIDE = duck.clean("src || ' ' || context")
_FUNCTION = f"({duck.test(_BESIDE, 'functional_image')} or {duck.test('lower(src)', 'functional_image_src')})"
_PLATE = f"({duck.test(_BESIDE, 'plate_caption')} or {duck.test('lower(src)', 'publisher_image_src')})"


@query(f"""select p_partkey, case policy when 'keep-all' then true when 'remove-all' then false else case when {_GENERIC} and standalone and (coalesce(width <= 280 and height <= 140, false) or context = '') then false
 when {_PLATE} and not {_FUNCTION} then false when coalesce(confidence >= 0.7, false) then decision else {_FUNCTION} end end as keep from (select {_PICTURE.format(s='varchar')} from part)""")
def q_image_decisions(spark, d):
    rows = tables.read(spark, d, "part").selectExpr(*(x.strip() for x in _split_select(_PICTURE.format(s="string"))))
    return rows.select("p_partkey", blocks.keep_image(*(c(n) for n in ("policy", "src", "alt", "context", "width", "height", "standalone", "decision", "confidence"))).alias("keep"))


# ---------------------------------------------------------------- contents

_ENTRIES = f"""(select book, doc_index as seq, doc_index % 5 as level, heading as title, 'p' || doc_index as target_id, case when kind = 'frontmatter' then 'frontmatter' else 'work' end as kind, doc_index % 2 as source_level, {duck.key('heading')} as key
 from {DUCK_KINDS} where heading <> '')"""
_USABLE = f"""(select * from (select *, count(*) over (partition by book) as many from (select *, row_number() over (partition by book, key order by seq) as n from {_ENTRIES}
 where key <> '' and not {duck.found(duck.display('title'), toc.SOURCE_CONTENTS)} and seq <> 3) where n = 1) where many > 1)"""


def _usable(spark, d):
    rows = tables.entries(spark, d)
    return toc.usable(rows, rows.where("seq <> 3").select("book", "target_id"))


@query(f"select book, seq, key, target_id from {_USABLE}")
def q_usable_toc(spark, d):
    return _usable(spark, d).select("book", "seq", "key", "target_id")


@query(f"select level, n from (select greatest(1, least(level, 4))::bigint as level, count(*) as n from {_USABLE} group by 1)")
def q_toc_levels(spark, d):
    return _usable(spark, d).groupBy(toc.level().cast("long").alias("level")).agg(F.count("*").alias("n"))


_LEADERS = "case when line_no % 3 = 0 then 'Chapter ' || (line_no % 6) || ' ..... ' || (line_no % 2) else text end"


@query(f"select book, key, count(*) as n from (select book, {duck.key(f'regexp_replace(t, {q(chr(92) + chr(46) + "{2,}" + chr(92) + "s*" + chr(92) + "d+" + chr(92) + "s*$")}, {q("")})')} as key from (select book, {_LEADERS} as t from {DUCK_LINES})) where key not in ('', 'contents') group by book, key having count(*) >= 4")
def q_toc_duplicates(spark, d):
    return toc.duplicates(tables.lines(spark, d).selectExpr("book", f"{_LEADERS} as line"))


_LINKS = "l_orderkey % 40 as book, l_linenumber as page, l_quantity as y, l_orderkey * 10 + l_linenumber as x, 't' || cast(l_suppkey % 5 as {s}) as target_id, 5 + l_partkey % 30 as target_page"


@query(f"""with l as (select {_LINKS.format(s='varchar')} from lineitem), f as (select book, target_id, target_page as first from (select *, row_number() over (partition by book, target_id order by page, y, x) as k from l where target_id <> 't4') where k = 1)
select book, target_id, greatest(1, first - case when book % 2 = 0 then 9 + book % 5 else min(first) over (partition by book) end + 1)::bigint as page_no from f""")
def q_toc_pages(spark, d):
    links = tables.read(spark, d, "lineitem").selectExpr(*_split_select(_LINKS.format(s="string")))
    entries = links.where("target_id <> 't4'").select("book", "target_id").distinct()
    return toc.page_numbers(links, entries, links.where("book % 2 = 0").select("book", (9 + c("book") % 5).alias("first_page")).distinct())


@query(f"""select book, '<ol class="toc-list toc-simple">' || chr(10) || string_agg('<li class="toc-level-1 toc-kind-' || kind || '"><a href="#' || target_id || '">' || {duck.escape(duck.title_case(duck.display('title')))} || '</a></li>', chr(10) order by seq) || chr(10) || '</ol>' as html from {_USABLE} group by book""")
def q_toc_markup(spark, d):
    return toc.markup(_usable(spark, d), simple=True)


@query(f"""with f as (select book, seq, '<p>' || {duck.escape('title')} || '</p>' as html from {_ENTRIES})
select book, '<!doctype html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>Book ' || book || '</title>' || chr(10) || '<link rel="stylesheet" href="style.css">' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) ||
 '<section class="frontmatter title-page"><h1>Book ' || book || '</h1></section>' || chr(10) || chr(10) || '<main class="main">' || chr(10) || string_agg(html, chr(10) order by seq) || chr(10) || '</main>' || chr(10) || '</body>' || chr(10) || '</html>' as html from f group by book""")
def q_compose_html(spark, d):
    rows = tables.entries(spark, d)
    fragments = rows.select("book", "seq", F.concat(F.lit("<p>"), text.html_escape(c("title")), F.lit("</p>")).alias("html"))
    books = rows.select("book").distinct().select("book", F.concat(F.lit("Book "), c("book").cast("string")).alias("title"))
    return compose.compose(fragments, books, spark.createDataFrame([], "book long, html string"))


# ---------------------------------------------------------------- quality

_STRIP = quality.STRIP


@query(f"""select book, page, 'line_spills' as "check", string_agg(text, ' ' order by line_no) as detail from (select *, row_number() over (partition by book, page order by line_no) as n from {DUCK_LINES}
 where regexp_matches(regexp_replace(text, {q(_STRIP)}, '', 'g'), '^[a-z]$') and not regexp_matches(regexp_replace(text, {q(_STRIP)}, '', 'g'), '(?i)^[ivxlcdm]+$')) where n <= 8 group by book, page""")
def q_line_spills(spark, d):
    return quality.line_spills(tables.lines(spark, d))


_FULL = f"(select *, row_number() over (partition by book, page order by line_no) as n, row_number() over (partition by book, page order by line_no desc) as back, count(*) over (partition by book, page) as many from {DUCK_LINES} where text <> '')"
_NO_HEAD = f"not {duck.found('text', quality.HEADING_LINE)}"


@query(f"""select book, page, 'widow_lines' as "check", substr(text, 1, 80) as detail from (select *, row_number() over (partition by book, page order by n) as k from {_FULL} where many >= 3 and length(text) < 15) where k = 1 and n <= 3 and page > 1 and {_NO_HEAD}
union all select book, page, 'widow_lines', substr(text, 1, 80) from {_FULL} where many >= 3 and back = 1 and length(text) > 3 and {_NO_HEAD}""")
def q_widows(spark, d):
    return quality.widows(tables.lines(spark, d))


_TAILED = "case when line_no % 25 = 0 then 'Chapter ' || line_no else text end"


@query(f"""select book, page, 'stranded_headings' as "check", substr(arg_min(text, line_no), 1, 100) as detail from (select *, row_number() over (partition by book, page order by line_no desc) as back, count(*) over (partition by book, page) as many from (select book, page, line_no, {_TAILED} as text from {DUCK_LINES}) where text <> '')
where many >= 3 and back <= 4 and page > 1 and {duck.found('text', quality.TAIL_HEADING)} group by book, page""")
def q_stranded_headings(spark, d):
    return quality.stranded_headings(tables.lines(spark, d).selectExpr("book", "page", "line_no", f"{_TAILED.replace('|| line_no', '|| cast(line_no as string)')} as text"))


@query(f"""select book, page, 'orphan_pages' as "check", count(*)::varchar as detail from {DUCK_LINES} where page > 1 and length(text) > 3 and not (upper(text) = text and lower(text) <> text) group by book, page having count(*) between 1 and 3""")
def q_orphan_pages(spark, d):
    return quality.orphan_pages(tables.lines(spark, d), after=1)


@query(f"""select book, page, 'narrow_columns' as "check", m::varchar as detail from (select book, page, list_sort(list(width))[len(list(width)) // 2 + 1] as m from {DUCK_LAID_OUT} where y > 80 and y < 760 and width > 20 group by book, page) where m < 300""")
def q_narrow_columns(spark, d):
    return quality.narrow_columns(tables.laid_out(spark, d))


@query(f"""select book, page, 'header_collisions' as "check", min(y)::varchar as detail from {DUCK_LAID_OUT} where text <> '' and y between 60 and 790 and not (y < 135 and size <= 10.2) group by book, page having min(y) < 80""")
def q_header_collisions(spark, d):
    return quality.header_collisions(tables.laid_out(spark, d), 80.0, 10.2)


@query(f"select lang, array_to_string(list_sort(list(distinct source)), ',') as fonts, count(distinct source) as n from documents group by lang")
def q_font_inventory(spark, d):
    return tables.read(spark, d, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("fonts"), F.countDistinct("source").alias("n"))


_MADE = "case when page = 2 and line_no % 26 = 1 then 'Contents' when line_no % 26 = 0 then ((page + 1) // 2)::varchar else text end"
_MADE_LINES = f"(select book, page, line_no, {_MADE} as text, y, size from {DUCK_LAID_OUT})"
_TEXTS = f"(select book, page, string_agg(text, chr(10) order by line_no) as text, count(*) as n_lines, arg_max(text, line_no) as last from {_MADE_LINES} where text <> '' group by book, page)"
_SAYS = f"regexp_matches(text, {q(preflight.CONTENTS)})"


def _made(spark, d):
    made = F.when((c("page") == 2) & (c("line_no") % 26 == 1), "Contents").when(c("line_no") % 26 == 0, F.expr("cast((page + 1) div 2 as string)")).otherwise(c("text"))
    return tables.laid_out(spark, d).withColumn("text", made)


@query(f"""with a as (select book, coalesce(max(case when page <= 30 and {_SAYS} then page end), 0) as after from {_TEXTS} group by book)
select l.book, min(l.page) as first_page from {_MADE_LINES} l join a on l.book = a.book where text = '1' and y > 700 and page > after and page <= after + 12 group by l.book""")
def q_first_body_page(spark, d):
    return preflight.first_body(_made(spark, d), low=700.0)


@query(f"""with a as (select book, max(page) as after from {_TEXTS} where page <= 20 and {_SAYS} group by book),
b as (select l.book, min(l.page) as page from {_MADE_LINES} l join a on l.book = a.book where text <> '' and not regexp_matches(text, {q(preflight.FOLIO)}) and page > after and page <= after + 6 group by l.book),
t as (select l.*, row_number() over (partition by l.book, l.page order by line_no desc) as back from {_MADE_LINES} l join b on l.book = b.book and l.page = b.page where text <> '')
select book, page, 'first_body_folio' as "check", d as detail from (select book, page, arg_max(text, line_no) filter (where regexp_matches(text, '^[0-9]+$')) as d from t where back <= 4 group by book, page) where d is not null and d <> '1'""")
def q_first_folio(spark, d):
    return preflight.first_folio(_made(spark, d))


@query(f"""select book, 1::bigint as page, 'toc_page_numbers' as "check", 'no leaders' as detail from {_MADE_LINES} where page <= 12 group by book having bool_or(contains(text, 'Contents')) and not bool_or(regexp_matches(text, '\\.{{2,}}\\s*[0-9]+'))""")
def q_missing_leaders(spark, d):
    return preflight.missing_leaders(_made(spark, d))


@query(f"""select l.book, l.page, l.line_no, l.text from {_MADE_LINES} l join (select book, min(page) as start from {_TEXTS} where page <= 20 and {_SAYS} group by book) f on l.book = f.book where l.page >= start and l.page < start + 4 and l.page <= 20""")
def q_contents_window(spark, d):
    return preflight.contents_window(_made(spark, d)).select("book", "page", "line_no", "text")


@query("select doc_id, array_to_string(list_distinct_ordered, ' ') as pages from (select doc_id, list_filter([1, 2, 3, 4, 5, 6, 9, 13, 21, 31, 51, 101], lambda p: p <= n) || case when n > 0 and not list_contains([1, 2, 3, 4, 5, 6, 9, 13, 21, 31, 51, 101], n) then [n] else [] end as list_distinct_ordered from (select doc_id, (n_chars // 60)::int as n from documents))")
def q_sampled_pages(spark, d):
    n = F.expr("n_chars div 60")
    return tables.read(spark, d, "documents").select("doc_id", F.array_join(F.transform(preflight.sampled_pages(n, 13), lambda p: p.cast("string")), " ").alias("pages"))


def _findings(spark, d):
    lines = tables.lines(spark, d)
    return quality.line_spills(lines).unionByName(quality.widows(lines)).unionByName(quality.orphan_pages(lines, after=1)).unionByName(quality.narrow_columns(tables.laid_out(spark, d)))


_FOUND = "(" + " union all ".join(f'select book, page, "check", detail from ({SQL[n]})' for n in ("q_line_spills", "q_widows", "q_orphan_pages", "q_narrow_columns")) + ")"


@query(f"""select "check", count(*) as n, count(distinct book) as books from {_FOUND} group by "check" """)
def q_findings_pivot(spark, d):
    return _findings(spark, d).groupBy("check").agg(F.count("*").alias("n"), F.countDistinct("book").alias("books"))


_HIT = f"""("check" in ({', '.join(map(q, quality.BLOCKERS))}))"""


@query(f"""select book, count(*) as findings, count(*) filter (where {_HIT}) as blockers, bool_or({_HIT}) as blocked from {_FOUND} group by book""")
def q_blockers(spark, d):
    return quality.verdict(_findings(spark, d))


@query(f"""select book, "check", string_agg('- p. ' || page || ': ' || coalesce(detail, ''), chr(10) order by page, detail) as lines from (select *, row_number() over (partition by book, "check" order by page, detail) as n from {_FOUND}) where n <= 5 group by book, "check" """)
def q_report_topn(spark, d):
    return quality.report(_findings(spark, d), most=5)


# ---------------------------------------------------------------- hashes, settings, jobs


@query("select doc_id, sha256(coalesce(text, '')) as hash from documents")
def q_content_hash(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


@query("select source as book, sha256(string_agg(sha256(coalesce(text, '')), '|' order by doc_id)) as hash from documents group by source")
def q_book_hash(spark, d):
    return dag.content_hash(tables.read(spark, d, "documents"), "source", "doc_id", "text").withColumnRenamed("source", "book")


_DEFAULTS, _CONFIG, _FLAGS = [("trim_size", "A4"), ("line_height", "1.23"), ("strict", "false"), ("title", "")], [("trim_size", "A5"), ("title", "X"), ("nonsense", "1")], [("title", "Y"), ("trim_size", None)]


@query(f"""select d.name, coalesce(f.value, e.value, d.value) as value, case when f.value is not null then 'cli' when e.value is not null then 'config' else 'default' end as layer, coalesce(f.value, e.value, d.value) <> d.value as overridden
from {duck.values(_DEFAULTS, 'name, value', 'd')} left join {duck.values(_CONFIG, 'name, value', 'e')} using (name) left join {duck.values(_FLAGS, 'name, value', 'f')} using (name)""")
def q_settings_precedence(spark, d):
    return settings.precedence(*(spark.createDataFrame(x, "name string, value string") for x in (_DEFAULTS, _CONFIG, _FLAGS)))


_RULES = [("backmatter_patterns", 0, "afterword"), ("backmatter_patterns", 1, "coda"), ("chapter_headings", 0, "stave")]


@query(f"""select name, case when a is null then pattern else '(?:' || pattern || ')|(?:' || a || ')' end as pattern from {duck.values(list(patterns.PATTERNS.items()), 'name, pattern', 'p')}
left join (select k.n as name, string_agg(pattern, '|' order by seq) as a from {duck.values(_RULES, 'key, seq, pattern', 'r')} join {duck.values([(k, n) for k, n in patterns.PACK_KEYS.items()], 'key, n', 'k')} using (key) group by k.n) using (name)""")
def q_pattern_merge(spark, d):
    registry = patterns.Registry()
    pack: dict[str, list[str]] = {}
    for key, _, rule in _RULES:
        pack.setdefault(key, []).append(rule)
    registry.apply(pack)
    registry.apply(pack)  # a second load changes nothing
    return registry.table(spark)


_BUMP = "p_size / 4.0 as old, (p_partkey % 5) * 0.125 as step, (p_partkey % 7) * 2.0 as most"


@query(f"select p_partkey, case when least(most, round(old + step, 3)) > old + 0.0001 then least(most, round(old + step, 3)) else old end::double as new from (select p_partkey, {_BUMP} from part)")
def q_autofix(spark, d):
    rows = tables.read(spark, d, "part").selectExpr("p_partkey", *_split_select(_BUMP))
    return rows.select("p_partkey", settings.bump(c("old").cast("double"), c("step").cast("double"), c("most").cast("double")).alias("new"))


_STATUS = "case user_id % 5 when 0 then 'failed' when 1 then 'skipped' else 'succeeded' end"


@query(f"select count(*) as total, count(*) filter (where s = 'succeeded') as succeeded, count(*) filter (where s = 'skipped') as skipped, count(*) filter (where s = 'failed') as failed from (select distinct user_id, {_STATUS} as s from events)")
def q_batch_report(spark, d):
    return jobs.batch_report(tables.read(spark, d, "events").selectExpr("user_id", f"{_STATUS} as status").distinct())


_PARSED = r"""(select job_id, seq, line, case when regexp_matches(line, '\[\s*([0-9]+)\s*/\s*([0-9]+)\]') then least(0.95, regexp_extract(line, '\[\s*([0-9]+)\s*/', 1)::double / greatest(1.0, regexp_extract(line, '/\s*([0-9]+)\]', 1)::double)) when contains(line, 'Wrote PDF:') then 1.0 end as progress,
 case when regexp_matches(line, '\[\s*([0-9]+)\s*/\s*([0-9]+)\]') then trim(regexp_extract(line, '\]\s*(.+?)\.\.\.', 1)) when contains(line, 'Wrote PDF:') then 'Complete' when starts_with(line, 'Auto-fix') then substr(line, 1, 120) end as stage from """ + DUCK_LOG + ")"


@query(f"select job_id, coalesce(arg_max(progress, case when progress is not null then seq end), 0.0)::double as progress, arg_max(stage, case when stage is not null then seq end) as stage, count(*) as lines from {_PARSED} group by job_id")
def q_job_progress(spark, d):
    return jobs.state(tables.log(spark, d))


@query(f"select job_id, string_agg(line, chr(10) order by seq) as tail from (select *, row_number() over (partition by job_id order by seq desc) as back from {DUCK_LOG}) where back <= 80 group by job_id")
def q_job_tail(spark, d):
    return jobs.tail(tables.log(spark, d))


@query(f"select stage, count(*) as jobs from (select job_id, arg_max(stage, seq) as stage from {_PARSED} where stage is not null group by job_id) group by stage")
def q_latest_stage(spark, d):
    return jobs.state(tables.log(spark, d)).groupBy("stage").agg(F.count("*").alias("jobs"))


# ---------------------------------------------------------------- ordered folds (no SQL twin; tested against sequential ones)


@query()
def q_unique_ids(spark, d):
    rows = tables.read(spark, d, "part").select((c("p_partkey") % 20).alias("book"), c("p_partkey").alias("seq"), c("p_name").alias("title"))
    return identity.unique_ids(rows)


@query()
def q_heading_fold(spark, d):
    rows = spine.carry_forward(spine.classify(tables.probed(spark, d))).where("heading <> ''")
    return headings.fold(rows.select("book", "doc_index", F.lit(0).cast("long").alias("block_no"), F.expr("cast(nullif(substring(tag, 2, 1), '') as long)").alias("level"), c("heading").alias("text"), F.lit(None).cast("string").alias("id"), "kind", "major_title", c("current_division").alias("division"), F.lit(False).alias("section"), (c("doc_index") % 2 == 0).alias("source_top")))


@query()
def q_clean_blocks(spark, d):
    return build.build(tables.read(spark, d, "pages"))["marked"]


@query()
def q_clean_audit(spark, d):
    return build.build(tables.read(spark, d, "pages"))["audit"]


@query()
def q_build_books(spark, d):
    return build.build(tables.read(spark, d, "pages"))["books"]


# ---------------------------------------------------------------- star schema: joins and aggregates at large


@query("""select l_returnflag, l_linestatus, sum(l_quantity)::double as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, count(*) as n from lineitem group by l_returnflag, l_linestatus""")
def q_pricing_summary(spark, d):
    rows = tables.read(spark, d, "lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("sum_disc_price"), F.count("*").alias("n"))


@query("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name""")
def q_revenue_by_nation(spark, d):
    line, orders = tables.read(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount"), tables.read(spark, d, "orders").select("o_orderkey", "o_custkey")
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey).join(tables.read(spark, d, "customer"), c("o_custkey") == c("c_custkey")).join(tables.read(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"))
