"""SQL that computes the same results as ``queries`` on the same tables, for DuckDB."""

from __future__ import annotations

import numpy as np

from askloom.functions import text as T
from askloom.functions.vectors import HASH_DIM
from askloom.operators.prompting import CONTEXT_GAP
from askloom.options import DEFAULT_CONTEXT_TEMPLATE, ChunkOptions, CleanOptions
from askloom.plans.queries import ALL_STEPS, DIM, EXTENSIONS, FILE_IDS, FILE_KINDS, LEADS, SMALL
from askloom.sources.routing import SUPPORTED_EXTENSIONS

ORACLE: dict[str, str] = {}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(T.SPACES)})"


def trailing(x: str) -> str:
    return f"rtrim({strip(x)}, {lit(T.TRAILING)})"


def dashes(x: str) -> str:
    return f"translate({x}, {lit(T.DASHES)}, '  ')"


def whitespace(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit('[' + T.SPACES + ']+')}, ' ', 'g'))"


def bullets(x: str) -> str:
    return f"regexp_replace({x}, {lit('^[' + T.BULLETS + ']+[' + T.SPACES + ']*')}, '')"


def clean(x: str, opts: CleanOptions = CleanOptions()) -> str:
    x = f"lower({x})" if opts.lowercase else x
    x = trailing(x) if opts.trailing_punctuation else x
    x = dashes(x) if opts.dashes else x
    x = whitespace(x) if opts.extra_whitespace else x
    x = bullets(x) if opts.bullets else x
    return strip(x)


def nth(values: tuple, place: str) -> str:
    return f"list_extract([{', '.join(lit(v) for v in values)}], ({place})::int)"


# ---------------------------------------------------------------- elements


def line_elements(table: str, key: str, text: str = "text", clean_opts: CleanOptions | None = None) -> str:
    """CTE body: (id, ord, category, text) from the lines of a text column."""
    value = clean(strip("raw"), clean_opts) if clean_opts else strip("raw")
    return f"""
      select id, row_number() over (partition by id order by pos) - 1 as ord, 'NarrativeText' as category, t as text
      from (select id, pos, {value} as t
            from (select {key} as id, unnest(string_split({text}, chr(10))) as raw,
                         unnest(range(len(string_split({text}, chr(10))))) as pos from {table})
            where {strip('raw')} <> '')
      where t <> ''"""


# Tags by hand, so that a wrong list in the code shows.
_REST = r"""(?:[\s/](?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|[="'])*)?>"""
_BLOCKS = (
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 head header hr html "
    "li main ol p pre section table tbody td tfoot th thead tr ul"
).split()


def _html(x: str) -> str:
    hidden = "|".join(rf"<{t}{_REST}.*?(?:</{t}(?:[\s/][^>]*)?>|\z)" for t in ("script", "style", "nav", "footer", "title"))
    x = f"regexp_replace({x}, {lit('(?is)<!--.*?(?:-->|' + chr(92) + 'z)|' + hidden)}, ' ', 'g')"
    x = f"regexp_replace({x}, {lit('(?i)<h[1-6]' + _REST)}, chr(64976) || chr(64977), 'g')"
    x = f"regexp_replace({x}, {lit('(?i)<li' + _REST)}, chr(64976) || chr(64978), 'g')"
    x = f"regexp_replace({x}, {lit('(?i)</?(?:' + '|'.join(_BLOCKS) + ')' + _REST)}, chr(64976), 'g')"
    x = f"regexp_replace({x}, {lit('</?[a-zA-Z][^' + chr(92) + 's/>]*' + _REST + '|<[!?][^>]*>')}, '', 'g')"
    for name, char in REFERENCES:
        x = f"replace({x}, {lit(name)}, {lit(char)})"
    return x


# Character references that the given pages hold, written out by hand.
REFERENCES = (("&nbsp;", "\u00a0"), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def html_elements(clean_opts: CleanOptions | None = None) -> str:
    value = strip("translate(raw, chr(64977) || chr(64978), '')")
    if clean_opts:
        value = clean(value, clean_opts)
    return f"""
      select id, row_number() over (partition by id order by pos) - 1 as ord, category, t as text
      from (select id, pos, {value} as t,
              case when starts_with(raw, chr(64977)) then 'Title' when starts_with(raw, chr(64978)) then 'ListItem'
                   else 'NarrativeText' end as category
            from (select id, unnest(parts) as raw, unnest(range(len(parts))) as pos
                  from (select page_id as id, string_split({_html('html')}, chr(64976)) as parts from pages)))
      where t <> ''"""


# ---------------------------------------------------------------- chunks

JAVA_SPACE = r"[ \t\n\r\f\x0b]"


def piece_ctes(source: str, n: int, prefix: str = "") -> str:
    """Recursive CTE ``pieces(id, i, piece)`` over ``source(id, text)``: cuts after white space."""
    window = f"substring(text, pos, {n})"
    cut = f"length(regexp_extract({window}, {lit('(?s)^.+' + JAVA_SPACE)}, 0))"
    piece = f"case when length(text) - pos + 1 <= {n - 1} then {window} when {cut} > 0 then left({window}, {cut}) else {window} end"
    return f"""
    {prefix}pieces as (
      select id, 0 as i, 1::bigint as pos, {piece.replace('pos', '1')} as piece, text from {source} where length(text) > 0
      union all
      select id, i + 1, pos, {piece}, text
      from (select id, i, pos + length(piece) as pos, text from {prefix}pieces)
      where pos <= length(text))"""


def overlapped(pieces: str, overlap: int) -> str:
    before = "lag(piece) over (partition by id order by i)"
    return f"select id, i, case when i = 0 then piece else right({before}, {overlap}) || piece end as piece from {pieces}" if overlap else f"select id, i, piece from {pieces}"


def chunk_ctes(elements: str, opts: ChunkOptions = ChunkOptions()) -> str:
    """CTEs ending in ``chunks(id, chunk_ord, text, n_chars)``; use after ``with recursive``."""
    hard, soft = opts.max_characters, opts.soft
    title = "e.category = 'Title' or " if opts.by_title else ""
    fresh = f"({title}f.cur is null or e.n > {hard} or f.cur > {soft} or f.cur + 2 + e.n > {hard})"
    return f"""
    e as (select id, ord, category, text, length(text) as n from ({elements})),
    fold as (
      select id, ord, true as fresh, case when n > {hard} then null else n end as cur from e where ord = 0
      union all
      select e.id, e.ord, {fresh},
             case when e.n > {hard} then null when {fresh} then e.n else f.cur + 2 + e.n end
      from fold f join e on e.id = f.id and e.ord = f.ord + 1),
    grouped as (select e.*, sum(fresh::int) over (partition by e.id order by e.ord) as g
                from e join fold using (id, ord)),
    packed as (select id, g, string_agg(text, chr(10) || chr(10) order by ord) as text,
                      count(*) = 1 and max(n) > {hard} as oversized from grouped group by id, g),
    big as (select id::varchar || '/' || g as id, text from packed where oversized),
    {piece_ctes('big', hard - opts.overlap)},
    cut as ({overlapped('pieces', opts.overlap)}),
    chunks as (
      select id, row_number() over (partition by id order by g, i) - 1 as chunk_ord, text, length(text) as n_chars
      from (select id, g, 0 as i, text from packed where not oversized
            union all
            select p.id, p.g, c.i, c.piece from packed p join cut c on c.id = p.id::varchar || '/' || p.g where p.oversized))"""


DOC_ELEMENTS = line_elements("documents", "doc_id", clean_opts=CleanOptions())
DOC_CHUNKS = chunk_ctes(DOC_ELEMENTS)
CHUNK_COLUMNS = "id as source_ord, chunk_ord, text, n_chars"
WITH_IDS = "ids as (select *, row_number() over (order by id, chunk_ord) - 1 as chunk_id from chunks)"


# ---------------------------------------------------------------- hashed tf-idf


def term_ctes(texts: str, name: str) -> str:
    """CTE ``name(key, bucket, tf)`` from ``texts(key, text)``."""
    return f"""
    {name} as (
      select key, bucket, count(*) as tf
      from (select key, ('0x' || substr(md5(t), 1, 8))::bigint % {HASH_DIM} as bucket
            from (select key, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) as t from ({texts}))
            where t <> '')
      group by key, bucket)"""


def weight_ctes(texts: str, questions: str = "select item_id as key, text from benchmark") -> str:
    """CTEs ``dw`` and ``qw`` (key, bucket, w), both under the idf of ``texts``."""
    idf = "ln((1 + n.n) / (1 + coalesce(df.df, 0))) + 1"
    return f"""
    {term_ctes(texts, 'dt')}, {term_ctes(questions, 'qt')},
    n as (select count(*)::double as n from ({texts})),
    df as (select bucket, count(*)::double as df from dt group by bucket),
    dw as (select key, bucket, tf * ({idf}) as w from dt left join df using (bucket), n),
    qw as (select key, bucket, tf * ({idf}) as w from qt left join df using (bucket), n)"""


def sparse_hits(limit: float, k: int | None) -> str:
    """CTEs ending in ``hits(query_id, chunk_id, distance, rank)``."""
    keep = f"where rank <= {k}" if k else ""
    return f"""
    dn as (select key, sqrt(sum(w * w)) as norm from dw group by key),
    qn as (select key, sqrt(sum(w * w)) as norm from qw group by key),
    dots as (select q.key as query_id, d.key as chunk_id, sum(q.w * d.w) as dot
             from qw q join dw d using (bucket) group by all),
    dist as (select query_id, chunk_id, round(1 - dot / (qn.norm * dn.norm), 6) as distance
             from dots join qn on qn.key = query_id join dn on dn.key = chunk_id),
    hits as (select * from (
               select query_id, chunk_id, case when distance = 0 then 0 else distance end as distance,
                      row_number() over (partition by query_id order by distance, chunk_id) as rank
               from dist where distance <= {limit}) {keep})"""


def context_cte(chunks: str, key: str) -> str:
    return f"""
    found as (select query_id, count(*)::int as n_hits,
                     string_agg(text || chr(10), {lit(CONTEXT_GAP)} order by distance, h.chunk_id) as context
              from hits h join {chunks} on {key} = h.chunk_id group by query_id)"""


def filled(context: str, message: str) -> str:
    before, rest = DEFAULT_CONTEXT_TEMPLATE.split("{context}")
    middle, after = rest.split("{user_message}")
    return f"{lit(before)} || {context} || {lit(middle)} || {message} || {lit(after)}"


# ---------------------------------------------------------------- dense vectors


def centres(key: str = "label") -> str:
    return f"""
    c as (select key, list(m order by i) as v from (
            select key, i, avg(x) as m from (
              select {key} as key, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings)
            group by key, i) group by key),
    v as (select vec_id as chunk_id, label, embedding::double[] as e from embeddings)"""


def distance(metric: str, a: str, b: str) -> str:
    dot = f"list_inner_product({a}, {b})"
    if metric == "ip":
        d = f"1 - {dot}"
    elif metric == "l2":
        d = f"pow(list_distance({a}, {b}), 2)"
    else:
        d = f"1 - {dot} / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
    return f"(case when round({d}, 6) = 0 then 0.0::double else round({d}, 6) end)"


def lsh_hits(dim: int, bands: int, bits: int, k: int, seed: int = 7) -> str:
    """Exact top-k among the vectors that share a band's signature; the seeded planes are written out."""
    planes = np.random.default_rng(seed).standard_normal((dim, bands * bits))
    rows = ", ".join(f"({p}, {i}, {planes[i, p]!r}::double)" for p in range(bands * bits) for i in range(dim))

    def codes(vectors: str, key: str, value: str) -> str:
        return f"""select key, p // {bits} as band, sum(case when side > 0 then 1 << (p % {bits}) else 0 end) as code
          from (select key, p, sum(x * a) as side
                from (select {key} as key, unnest({value}) as x, unnest(range({dim})) as i from {vectors}) join planes using (i)
                group by key, p) group by key, band"""

    return f"""with {centres()}, planes(p, i, a) as (values {rows.replace("np.float64", "")}),
    vc as ({codes('v', 'chunk_id', 'e')}), qc as ({codes('c', 'c.key', 'v')}),
    pairs as (select distinct qc.key as qk, vc.key as ck from qc join vc using (band, code)),
    s as (select c.key::bigint as query_id, chunk_id, {distance('cosine', 'v.e', 'c.v')} as distance
          from pairs join v on chunk_id = ck join c on c.key = qk),
    r as (select *, row_number() over (partition by query_id order by distance, chunk_id) as rank from s where distance <= 2)
    select query_id, chunk_id, distance, rank from r where rank <= {k}"""


def dense_hits(metric: str, limit: float | None, k: int | None, key: str = "label", above: float | None = None) -> str:
    where = f"where distance <= {limit}" if limit is not None else ""
    keep = [f"rank <= {k}"] if k else []
    keep += [f"distance <= {above}"] if above is not None else []
    return f"""with {centres(key)},
    s as (select c.key::bigint as query_id, chunk_id, {distance(metric, 'v.e', 'c.v')} as distance from v, c),
    r as (select *, row_number() over (partition by query_id order by distance, chunk_id) as rank from s {where})
    select query_id, chunk_id, distance, rank from r {'where ' + ' and '.join(keep) if keep else ''}"""


# ---------------------------------------------------------------- conversations

TURNS = """(select conv_id, turn, case when role = 'assistant' and length(text) < 400 then 'user' else role end as role, text
            from conversations)"""
COLLAPSED = f"""(select conv_id, turn, role, text from (
                  select *, lead(role) over (partition by conv_id order by turn) as following from {TURNS})
                 where not (role = 'user' and coalesce(following = 'user', false)))"""


def history(rows: str, pairs: int) -> str:
    frame = f"over (partition by conv_id order by turn rows between {2 * pairs} preceding and 1 preceding)"
    return f"(select *, coalesce(list(role || ': ' || text) {frame}, []) as past from {rows})"


PAST = "coalesce(array_to_string(past, ' | '), '')"
REQUESTS = f"""(select conv_id || '-' || turn as request_id, text,
                  case when conv_id % 2 = 0 then ['system: Be brief.'] else [] end || past || ['user: ' || text] as said
                from {history(COLLAPSED, 2)} where role = 'user')"""
PATHS = f"""(select conv_id, turn, role, text, case when role = 'user' then
               'up/' || conv_id || {nth(('.PNG', '.webp', '.gif', '', '.tar.jpg'), 'conv_id % 5 + 1')} end as path
             from conversations)"""

# ---------------------------------------------------------------- sources

_EXT = nth(EXTENSIONS, f"doc_id % {len(EXTENSIONS)} + 1")
FILES = f"""(select doc_id::varchar as source_id, doc_id as source_ord, 'file' as kind,
               source || '/' || doc_id || case when {_EXT} = '' then '' else '.' || {_EXT} end as uri from documents)"""
_GATED = f"""(select *, case when ext in ({', '.join(lit(e) for e in SUPPORTED_EXTENSIONS)}) then 'loaded' else 'unsupported' end as status
              from (select *, lower(regexp_extract(uri, '\\.([^./]+)$', 1)) as ext from {FILES}))"""
_SITE = "https://www.youtube.com/"
_LINKS = f"""(select page_id, url_ord, url, case when contains(url, 'youtube.com') then 'video' else 'page' end as route from (
    select page_id, unnest(u) as url, unnest(range(len(u)))::int as url_ord from (
      select page_id, [url, '{_SITE}watch?v=' || code || '&t=7s', '{_SITE}live/' || code, '{_SITE}live/' || code || '?x=1'] as u
      from (select *, left(md5(url), 11) as code from pages))))"""
_VIDEO = "string_split(string_split(string_split(string_split(url, 'watch?v=')[-1], '&')[1], 'live/')[-1], '&')[1]"
_TRACKS = """(select 'video' || lpad(conv_id::varchar, 6, '0') as video_id, case when conv_id % 3 = 0 then 'en' else 'ru' end as lang,
               role = 'assistant' as is_generated, turn as seq, text from conversations)"""
_LED = f"""(select doc_id, line, {nth(LEADS, f'line % {len(LEADS)} + 1')} || chr(9) || t || '  ' as text from (
    select doc_id, unnest(string_split(text, chr(10))) as t, unnest(range(len(string_split(text, chr(10)))))::int as line from documents))"""


def _flat(x: str) -> str:
    return f"regexp_replace({x}, {lit(JAVA_SPACE + '+')}, ' ', 'g')"


def _heading(mark: str) -> str:
    pattern = T.MARKDOWN_HEADING if mark == "#" else T.ORG_HEADING
    lead = mark + " " if mark == "#" else "** "
    source = f"(select doc_id, {lit(lead)} || text as text from documents)"
    return f"""select id as source_ord, ord as elem_ord, case when regexp_matches(text, {lit(pattern)}) then 'Title' else category end as category,
      regexp_replace(text, {lit(pattern)}, '') as text from ({line_elements(source, 'doc_id')})"""


ORACLE.update(
    source_gate=f"select source_id, uri, ext, status from {_GATED}",
    url_route=f"select * from {_LINKS}",
    video_id=f"select page_id, url_ord, {_VIDEO} as video_id, length({_VIDEO}) = 11 as valid from {_LINKS} where route = 'video'",
    url_status=f"""select page_id, url_ord, url, case when route = 'video' and length({_VIDEO}) <> 11 then 'invalid_url' else 'loaded' end as status
      from (select * replace (case when route = 'video' and page_id % 3 = 0 and url_ord = 2 then left(url, length(url) - 1) else url end as url)
            from {_LINKS})""",
    ingest_union=f"""select source_id, source_ord, kind, uri from {FILES} union all
      select url, page_id + (select max(doc_id) + 1 from documents), 'page', url from pages""",
    ingest_log=f"""with recursive {DOC_CHUNKS},
      log as (select g.source_id, case when g.status = 'loaded' and coalesce(k.n, 0) = 0 then 'no_text' else g.status end as status,
                case when g.status = 'loaded' then coalesce(k.n, 0) else 0 end as n
              from {_GATED} g left join (select id::varchar as source_id, count(*) as n from chunks group by 1) k using (source_id))
      select status, count(*) as n_sources, sum(n)::bigint as n_chunks from log group by status""",
    csv_elements=f"""select 'NarrativeText' as category, part, elem_ord,
        trim(case when part = 'short' then doc_id || ' ' else doc_id || ' ' || lang || ' say "' || source || '", ok ' end || trim({_flat('text')})) as text
      from (select *, case when doc_id % 2 = 0 then 'short' else 'long' end as part,
              row_number() over (partition by doc_id % 2 order by doc_id) - 1 as elem_ord from documents)""",
    tsv_elements=f"""select 'NarrativeText' as category, row_number() over (order by conv_id, turn) - 1 as elem_ord,
        conv_id || ' ' || turn || ' ' || role || ' ' || trim({_flat('text')}) as text from conversations""",
    md_elements=_heading("#"),
    org_elements=_heading("*"),
    ooxml_elements=f"""select doc_id || '.' || {nth(('docx', 'pptx', 'xlsx'), 'doc_id % 3 + 1')} as source_id, ord as elem_ord, category, e.text, null::varchar as error
      from ({line_elements('documents', 'doc_id')}) e join documents on doc_id = id""",
    page_elements=f"select id as source_ord, ord as elem_ord, category, text from ({html_elements()})",
    transcript_text=f"""select video_id, is_generated, string_agg(text, chr(10) order by seq) as text from {_TRACKS} t
      where lang = 'ru' and is_generated = (select min(is_generated) from {_TRACKS} u where u.video_id = t.video_id and u.lang = 'ru')
      group by all""",
    transcript_status=f"""select video_id, case when track is null and known is null then 'no_subtitles' when track is null then 'lang_missing' else 'loaded' end as status,
      case track when 0 then 'manual' when 1 then 'automatic' end as detail
      from (select 'video' || lpad(doc_id::varchar, 6, '0') as video_id from documents)
      left join (select video_id, true as known, min(case when lang = 'ru' then is_generated::int end) as track from {_TRACKS} group by 1) using (video_id)""",
    text_elements=f"select id as source_ord, ord as elem_ord, category, text from ({line_elements('documents', 'doc_id')})",
    clean_bullets=f"select doc_id, line, {bullets('text')} as text from {_LED}",
    clean_whitespace=f"select doc_id, line, {whitespace('text')} as text from {_LED}",
    clean_dashes=f"select doc_id, line, {dashes('text')} as text from {_LED}",
    clean_trailing=f"select doc_id, line, {trailing('text')} as text from {_LED}",
    clean_lower=f"select doc_id, line, lower(text) as text from {_LED}",
    clean_all=f"select doc_id, line, {clean('text', ALL_STEPS)} as text from {_LED}",
    chunk_basic=f"with recursive {DOC_CHUNKS} select {CHUNK_COLUMNS} from chunks",
    chunk_rows=f"with recursive {DOC_CHUNKS} select {CHUNK_COLUMNS} from chunks",
    chunk_text=f"""with recursive {chunk_ctes(line_elements('conversations', 'conv_id * 1000000000 + turn', clean_opts=ALL_STEPS), SMALL)}
      select {CHUNK_COLUMNS} from chunks""",
    split_oversized=f"""with recursive src as (select doc_id as id, text from documents), {piece_ctes('src', 100)}
      select id as source_ord, i as piece_no, piece from pieces""",
    split_overlap=f"""with recursive src as (select item_id as id, text from benchmark), {piece_ctes('src', 80)}
      select id as query_id, i as piece_no, piece from ({overlapped('pieces', 20)})""",
    chunk_by_title=f"""with recursive {chunk_ctes(html_elements(CleanOptions()), ChunkOptions(chunking_strategy='by_title'))}
      select {CHUNK_COLUMNS} from chunks""",
    chunk_ids=f"with recursive {DOC_CHUNKS}, {WITH_IDS} select id as source_ord, chunk_ord, chunk_id, n_chars from ids",
    render_chunks=f"with recursive {DOC_CHUNKS} select id as source_ord, chunk_ord, text || chr(10) as text from chunks",
    build_collection=f"""with recursive {DOC_CHUNKS}
      select doc_id::varchar as source_id, doc_id::varchar as uri, case when n > 0 then 'loaded' else 'no_text' end as status, coalesce(n, 0) as n_chunks
      from documents left join (select id, count(*) as n from chunks group by id) on id = doc_id""",
    collection_roundtrip=f"""with recursive {DOC_CHUNKS}, {WITH_IDS}
      select '123' as collection, chunk_id, id as source_ord, chunk_ord, text from ids""",
    collection_scan=f"""with recursive {DOC_CHUNKS}, {WITH_IDS}
      select '123' as collection, chunk_id, id::varchar as source_id, n_chars from ids""",
    collection_count=f"with recursive {DOC_CHUNKS} select '123' as collection, count(*) as n_chunks from chunks",
    retrieve_all=f"with recursive {DOC_CHUNKS}, {WITH_IDS} select chunk_id, text from ids",
    hash_embed=f"with {weight_ctes('select doc_id as key, text from documents')} select key as chunk_id, bucket::int as bucket, round(w, 6) as w from dw",
    embed_queries=f"with {weight_ctes('select doc_id as key, text from documents')} select key as query_id, bucket::int as bucket, round(w, 6) as w from qw",
    l2_normalize="""select chunk_id, i, round(x / sqrt(list_inner_product(e, e)), 6) as x from (
      select vec_id as chunk_id, e, unnest(e) as x, unnest(range(len(e)))::int as i
      from (select vec_id, list_transform(embedding, lambda y: y::double + 0.25) as e from embeddings))""",
    topk_single=f"select chunk_id, distance from ({dense_hits('cosine', 0.9, 5, key='0')})",
    knn_join=dense_hits("cosine", None, 5),
    knn_lsh=lsh_hits(DIM, 24, 4, 5),
    knn_cells=dense_hits("cosine", None, 5),
    knn_cells_l2=dense_hits("l2", 2, 3),
    knn_indexed=lsh_hits(DIM, 24, 4, 5),
    knn_l2=dense_hits("l2", 2, 3),
    knn_ip=dense_hits("ip", 2, 3),
    knn_threshold=dense_hits("cosine", None, 5, above=0.65),
    range_search=dense_hits("cosine", 0.9, None),
    sparse_knn=f"with {weight_ctes('select doc_id as key, text from documents')}, {sparse_hits(0.8, 3)} select * from hits",
    context_concat=f"""with {weight_ctes('select doc_id as key, text from documents')}, {sparse_hits(0.8, 3)},
      {context_cte('documents', 'doc_id')} select * from found""",
    no_context_questions=f"""with {weight_ctes('select doc_id as key, text from documents')}, {sparse_hits(0.8, 3)}
      select item_id as query_id, text from benchmark where item_id not in (select query_id from hits)""",
    prompt_fill="""select conv_id, turn, '{ctx} ' || c || chr(10) || '--' || chr(10) || text || ' / ' || c as prompt
      from (select *, role || '{user_message}' as c from conversations)""",
    blank_filter=f"""select * from (select conv_id, turn, case when role = 'system' then ' ' || chr(9) || ' ' || chr(10) || ' ' else text end as text from conversations)
      where length({strip('text')}) > 0""",
    effective_message="select conv_id, turn, case when role = 'user' then 'ctx: ' || text else text end as message from conversations",
    collapse_user_turns=f"select * from {COLLAPSED}",
    history_window=f"select conv_id, turn, len(past)::int as n, {PAST} as history from {history(TURNS, 2)}",
    system_prepend="""select conv_id, turn, s::int as n, case when s then 'system: ' || text else '' end as messages
      from (select *, turn < 5 and role = 'system' and length(text) > 0 as s from conversations)""",
    content_parts=f"select conv_id, turn, case when role in ('user', 'assistant') then text end as text, path from {PATHS}",
    attachment_filter=f"select conv_id, turn, path from {PATHS} where regexp_matches(lower(path), '[^/]\\.(png|jpg|jpeg|webp)$')",
    build_messages=f"select request_id, len(said)::int as n, array_to_string(said, ' | ') as messages from {REQUESTS}",
    sampling_params="""select conv_id, turn, 0.2::double as temperature, case when turn % 2 = 0 then 0.9 else 0.0 end::double as top_p,
      case when turn % 2 = 0 then 40 else 1 end as top_k, 1.0::double as repeat_penalty, -1 as max_tokens from conversations""",
    request_rows=f"""select request_id, 0.2::double as temperature, case when split_part(request_id, '-', 2)::bigint % 2 = 0 then 0.9 else 0.0 end::double as top_p,
      case when split_part(request_id, '-', 2)::bigint % 2 = 0 then 40 else 1 end as top_k, 1.0::double as repeat_penalty, 'false' as enable_thinking,
      string_split(said[1], ':')[1] as first_role, len(said)::int as n from {REQUESTS}""",
    running_concat="""select answer_id, seq, string_agg(tok, '') over (partition by answer_id order by seq rows unbounded preceding) as content
      from (select item_id as answer_id, unnest(string_split(text, ' ')) || ' ' as tok, unnest(range(len(string_split(text, ' ')))) as seq from benchmark)""",
    collections_exist="""select conv_id::varchar as name, conv_id = (select min(conv_id) from conversations) as found
      from conversations where conv_id is not null group by conv_id""",
    template_status="""select conv_id, turn,
        case when text like '%x%' and conv_id % 3 = 0 then 'missing: context' when conv_id % 3 = 1 then 'missing: user_message'
             when conv_id % 3 = 2 then 'ok' else 'missing: context, user_message' end as status from conversations""",
    rollback_failed="""with f as (select conv_id, turn from conversations where role = 'assistant' and length(text) % 2 = 0)
      select * from conversations c where not exists (select 1 from f where f.conv_id = c.conv_id and c.turn in (f.turn, f.turn - 1))""",
    batch_generate=f"select request_id, len(said) || ': ' || text as answer, null::varchar as error from {REQUESTS}",
    embed_udf="""select doc_id as source_ord, 26 as dim, null::varchar as error,
      round(case when s > 0 then len(regexp_extract_all(lower(text), 'e')) / sqrt(s) else 0 end, 3)::double as share_e
      from (select doc_id, text, list_sum(list_transform(range(97, 123), lambda c: pow(length(lower(text)) - length(replace(lower(text), chr(c::int), '')), 2))) as s from documents)""",
    line_count="select sum(len(string_split(text || chr(10), chr(10))))::bigint as n_lines from documents",
    stream_ingest=f"with recursive {DOC_CHUNKS} select {CHUNK_COLUMNS} from chunks",
    stream_latest_turn="""select conv_id, max(turn) as turn, arg_max(text, turn) as text from conversations where role = 'user' group by conv_id""",
)

_PREVIEW = """select doc_id as chunk_id, unnest(range(len(l)))::int as line_no, unnest(l) as line
  from (select doc_id, string_split(text || chr(10), chr(10)) as l from documents)"""
ORACLE["preview_lines"] = f"select * from ({_PREVIEW}) order by chunk_id, line_no limit 200"
ORACLE["preview_all_lines"] = _PREVIEW

for _metric in ("cosine", "l2", "ip"):
    ORACLE[f"{_metric}_distance"] = f"""with {centres()}
      select chunk_id, label::bigint as label, {distance(_metric, 'v.e', 'c.v')} as distance from v join c on c.key = v.label"""


ORACLE["stream_search"] = f"""with recursive {DOC_CHUNKS}, {WITH_IDS},
  {weight_ctes('select chunk_id as key, text from ids')}, {sparse_hits(0.6, 3)}
  select query_id, rank, id::varchar as source_id, chunk_ord, distance, text from hits join ids using (chunk_id)"""


def _letters(x: str) -> str:
    return f"list_transform(range(97, 123), lambda c: (length(lower({x})) - length(replace(lower({x}), chr(c::int), '')))::double)"


ORACLE["rag_prompts_model"] = f"""with recursive {DOC_CHUNKS}, {WITH_IDS},
  dv as (select chunk_id, v from (select chunk_id, {_letters('text')} as v from ids) where list_sum(v) > 0),
  qv as (select item_id as query_id, v from (select item_id, {_letters('text')} as v from benchmark) where list_sum(v) > 0),
  dist as (select query_id, chunk_id, {distance('cosine', 'qv.v', 'dv.v')} as distance from qv, dv),
  hits as (select * from (select *, row_number() over (partition by query_id order by distance, chunk_id) as rank
                          from dist where distance <= 0.01) where rank <= 2),
  {context_cte('ids', 'ids.chunk_id')}
  select item_id as query_id, case when context is null then 'no_context' else 'answered' end as status,
         coalesce(n_hits, 0)::int as n_hits, context, {filled('context', 'text')} as prompt
  from benchmark left join found on query_id = item_id"""


def _rag(limit: float, k: int | None, columns: str, asked: str = "select item_id, text from benchmark", ctes: str = "") -> str:
    """``asked``: item_id, text. ``ctes``: of further CTEs that it names, and those that follow."""
    before, after = ctes if ctes else ("", "")
    keyed = f"select item_id as key, text from ({asked}) where length({strip('text')}) > 0"
    return f"""with recursive {before} {DOC_CHUNKS}, {WITH_IDS},
      {weight_ctes('select chunk_id as key, text from ids', keyed)}, {sparse_hits(limit, k)},
      {context_cte('ids', 'ids.chunk_id')},
      p as (select item_id as query_id,
              case when length({strip('text')}) = 0 then 'blank' when context is null then 'no_context' else 'answered' end as status,
              coalesce(n_hits, 0)::int as n_hits, context, {filled('context', 'text')} as prompt
            from ({asked}) left join found on query_id = item_id){after}
      select {columns} from p"""


_MD = lit(T.MARKDOWN_HEADING)
_N = len(FILE_KINDS)
_FILED = f"(select doc_id, doc_id % 5 as k, doc_id // {FILE_IDS} as b, text from documents)"
_FILES_END = f"(select {_N} * (max(doc_id) // {FILE_IDS} + 1) from documents)"
_PAGES_END = f"({_FILES_END} + (select max(page_id) + 1 from pages))"
_SOURCE_TEXTS = f"""
    raw as (
      select k + {_N} * b as id, doc_id as o1, pos as o2, case when k = 1 then regexp_replace(t, {_MD}, '') else t end as t from (
        select *, {strip('l')} as t from (
          select k, b, doc_id, unnest(ls) as l, unnest(range(len(ls))) as pos
          from (select *, string_split(case when k = 1 then '# ' || text else text end, chr(10)) as ls from {_FILED} where k in (0, 1, 2, 4) and not (k = 4 and b % 4 = 1))))
      union all select 2 + {_N} * b, doc_id, -1, doc_id::varchar from {_FILED} where k = 2
      union all select 3 + {_N} * b, doc_id, 0, trim(doc_id || ' ' || trim({_flat('text')})) from {_FILED} where k = 3
      union all select {_FILES_END} + id, ord, 0, text from ({html_elements()}) where id % 50 <> 7
      union all select {_PAGES_END} + right(video_id, 6)::bigint, seq, 0, text from {_TRACKS} t
        where lang = 'ru' and right(video_id, 6)::bigint % 10 < 8
          and is_generated = (select min(is_generated) from {_TRACKS} u where u.video_id = t.video_id and u.lang = 'ru')),
    said as (select id, row_number() over (partition by id order by o1, o2) - 1 as ord, 'NarrativeText' as category, t as text
             from (select id, o1, o2, {clean('t')} as t from raw) where t <> '')"""
ORACLE["rag_prompts_indexed"] = ORACLE["rag_prompts_model"]
ORACLE["ingest_sources"] = f"""with recursive {_SOURCE_TEXTS}, {chunk_ctes('select * from said')}, {WITH_IDS}
  select chunk_id, id as source_ord, chunk_ord, text from ids"""
ORACLE["ingest_sources_log"] = f"""with recursive {_SOURCE_TEXTS}, {chunk_ctes('select * from said')},
  list as (
    select distinct k + {_N} * b as id, case when k = 4 and b % 4 = 1 then 'error' else 'loaded' end as status from {_FILED}
    union all select distinct {_N} * b + u, case u when 5 then 'unsupported' else 'error' end from {_FILED}, (values (5), (6)) v(u)
    union all select {_FILES_END} + page_id, case when page_id % 50 = 7 then 'error' else 'loaded' end from pages
    union all select distinct {_PAGES_END} + conv_id, case when conv_id % 10 = 9 then 'invalid_url' when conv_id % 10 = 8 then 'no_subtitles'
      when conv_id % 3 = 0 then 'lang_missing' else 'loaded' end from conversations),
  counts as (select id, count(*) as n from chunks group by id)
  select list.id::varchar as source_id, case when status = 'loaded' and n is null then 'no_text' else status end as status,
    case when status = 'loaded' then coalesce(n, 0) else 0 end as n_chunks from list left join counts using (id)"""
ORACLE["rag_prompts"] = _rag(0.5, 2, "query_id, status, n_hits, context, prompt")
_OPEN = f"""open as (
    select c.conv_id, turn, role, case when turn = last and c.conv_id % 11 = 5 then ' ' || chr(10) || ' ' else text end as text
    from conversations c join (select conv_id, max(turn) as last from conversations where role = 'user' group by conv_id) l using (conv_id) where turn <= last),
  standing as (select conv_id, turn, role, text from (select *, lead(role) over (partition by conv_id order by turn) as following from open)
    where not (role = 'user' and coalesce(following = 'user', false))),
  asked as (select * from (select *, coalesce(list(role || ': ' || text) over (partition by conv_id order by turn rows between 2 preceding and 1 preceding), []) as past,
      row_number() over (partition by conv_id order by turn desc) as back from standing) where back = 1 and role = 'user'),"""
_SENT = """, sent as (select query_id as conv_id, turn, status, (len(past) + 2) || ': ' || prompt as said from p join asked on conv_id = query_id),
  answers as (select conv_id, turn, case when status = 'answered' and length(said) % 7 = 0 then 'failed' else status end as status,
    case when length(said) % 7 > 0 then said end as answer, case when length(said) % 7 = 0 then 'ValueError: refused' end as error from sent)"""


def _chat(columns: str) -> str:
    return _rag(0.6, 2, columns, "select conv_id as item_id, text from asked", (_OPEN, _SENT)).rsplit(" from p", 1)[0]


ORACLE["chat_answers"] = _chat("*") + " from answers"
ORACLE["chat_continued"] = (
    _chat("conv_id, turn, role, text")
    + """ from standing s where not exists (select 1 from answers a where a.conv_id = s.conv_id and a.turn = s.turn and a.status <> 'answered')
    union all select conv_id, turn + 1, 'assistant', answer from answers where status = 'answered'"""
)
ORACLE["stream_prompts"] = ORACLE["rag_prompts"]
ORACLE["rag_prompts_max"] = _rag(0.6, None, "query_id, status, n_hits, prompt")
