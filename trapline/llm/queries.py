"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm import alignment, decontaminate, graph, jaccard, language, lines, mixing, page_text, phrases, pseudo_likelihood, shards, toxicity, urls
from trapline.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, read) -> DataFrame``; ``read`` gives a table by name."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            configure(spark)
            return fn(spark, lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _url_sql() -> str:
    terms = lambda column, words: " + ".join(f"cast(regexp_matches({column}, '(^|[^a-z0-9]){w}($|[^a-z0-9])') as int)" for w in sorted(words))
    weight = " + ".join(f"{urls.SOFT[w]} * cast(regexp_matches(low, '(^|[^a-z0-9]){w}($|[^a-z0-9])') as int)" for w in sorted(urls.SOFT))
    rules = " union all ".join(f"select '{r.partition('/')[0]}' as rh, '/{r.partition('/')[2]}' as rp, '{r}' as rule, '{v}' as rv" for v, r in URL_RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with cut as (select *, row_number() over () as rn, coalesce(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end, '') as rest,
    translate(coalesce(url, ''), '{upper}', '{lower}') as low from pages),
parts as (select rn, page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') as host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from cut),
hits as (select *, cast({terms('low', urls.STRICT)} as int) as strict_hits, cast({terms('low', urls.SOFT)} as int) as soft_hits,
    cast({weight} as double) as soft_weight from parts),
rules as ({rules}),
fit as (select rn, max_by(rule, length(rule)) as rule, max_by(rv, length(rule)) as rv from parts join rules
    on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by rn)
select page_id, host, path, rule, coalesce(rv, case when strict_hits > 0 or (soft_hits >= 2 and soft_weight >= 1) then 'block' else 'allow' end) as verdict,
    strict_hits, soft_hits, soft_weight
from hits left join fit using (rn)"""


@query("op1_url_filters", _url_sql())
def _(spark, read):
    """Every page's url judged by host rules and the weighted vocabulary."""
    return urls.judge_pages(read("pages"), rules=URL_RULES)


@query("op4_sharding")
def _(spark, read):
    """All documents in eight shards of near equal bytes, equal texts together."""
    return shards.shard_documents(read("documents").select("doc_id", "text"))


@query("op6_language_id")
def _(spark, read):
    """The language of every document by rank-order profiles."""
    return language.identify_documents(read("documents").select("doc_id", "text", "lang"))


def _passage_sql() -> str:
    low = lambda c: f"regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+')"
    seed = lambda w, at, mask: "concat_ws(' ', " + ", ".join(f"{w}[{at} + {i + 1}]" for i, bit in enumerate(mask) if bit == "1") + ")"
    laid = lambda table, w, cols: " union all ".join(
        f"select {cols}, {k} as mask, pos, {seed(w, 'pos', mask)} as seed from (select *, unnest(range(0, len({w}) - {len(mask) - 1})) as pos from {table})"
        for k, mask in enumerate(decontaminate.MASKS)
    )
    return f"""
with docs as (select doc_id, {low('text')} as w from documents where text is not null),
items as (select *, len(iw) as n, row_number() over () as item from (select distinct item_id, list_filter({low('text')}, lambda x: x <> '') as iw from benchmark where text is not null)),
ds as ({laid('docs', 'w', 'doc_id, w')}),
bs as ({laid('items', 'iw', 'item, item_id, iw, n')}),
hits as (select distinct doc_id, w, item, item_id, iw, n, ds.pos - bs.pos as shift from ds join bs using (mask, seed)),
same as (select doc_id, item_id, n, least(n, 20) as win,
    list_transform(range(0, n), lambda i: case when shift + i >= 0 and shift + i < len(w) and w[shift + i + 1] = iw[i + 1] then 1 else 0 end) as e from hits),
best as (select doc_id, item_id, win, list_max(list_transform(range(0, n - win + 1), lambda o: list_sum(e[o + 1:o + win]))) as m from same)
select doc_id, item_id, cast(win as int) as "window", cast(max(m) as int) as matched from best
where m >= win - case when win >= 15 then win // 5 else 0 end group by doc_id, item_id, win"""


@query("op3_decontamination", _passage_sql())
def _(spark, read):
    """Documents that hold passages of the benchmark, with up to a fifth of the words replaced."""
    return decontaminate.passages(read("documents").select("doc_id", "text"), read("benchmark"))


@query("op10_jaccard_join")
def _(spark, read):
    """Components of documents that share three quarters of their five-word shingles."""
    return jaccard.link_components(read("documents").select("doc_id", "text"))


@query("op8_mixing")
def _(spark, read):
    """What a mix of all sources by weight takes of every document."""
    return mixing.mix_documents(read("documents").select("doc_id", "text", "source"))


@query("op9_toxicity")
def _(spark, read):
    """Every document's probability of being toxic."""
    return toxicity.score_documents(read("documents").select("doc_id", "text"), read("labels").select("doc_id", "toxic"))


@query("op2_nearest_neighbours")
def _(spark, read):
    """The 20 nearest rows by inner product of every row whose id is divisible by 20."""
    return graph.nearest(read("embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@query("op5_pseudo_likelihood")
def _(spark, read):
    """Masked pseudo-likelihood of every document under a network trained on all of them."""
    return pseudo_likelihood.score_documents(read("documents").select("doc_id", "text"))


@query("op7_line_dedup")
def _(spark, read):
    """Every line that repeats an earlier one, nearly or wholly."""
    return lines.repeated_lines(read("documents").select("doc_id", "text"))


@query("op11_page_text")
def _(spark, read):
    """The main text of every page."""
    return page_text.main_text(read("pages").select("page_id", "url", "html"))


@query("op12_token_alignment")
def _(spark, read):
    """Every document's alignment of two tokenizers, with the corpus-wide counts of its linked token pairs."""
    return alignment.align_documents(read("documents").select("doc_id", "text"))


_PHRASE_SQL = """
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
totals as (select lang, cast(sum(len(w)) as bigint) as n from words group by lang),
runs as (select lang, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) as p from words),
f as (select lang, p, count(*) as a from runs group by lang, p),
cuts as (select lang, p, a, unnest(range(1, len(p))) as k from f where len(p) > 1 and a >= 10),
parts as (select c.lang, c.p, c.a, k, x.a as l, y.a as r, cast(1000000 * c.a::hugeint * c.a::hugeint // (x.a::hugeint * y.a::hugeint) as bigint) as score
    from cuts c join f x on x.lang = c.lang and x.p = c.p[1:k] join f y on y.lang = c.lang and y.p = c.p[k + 1:]),
lowest as (select * from parts qualify row_number() over (partition by lang, p order by score, k) = 1),
longer as (select lang, q, max(a) as most from (select lang, a, unnest([p[1:2], p[2:3]]) as q from lowest where len(p) = 3) group by lang, q),
alone as (select lowest.*, array_to_string(p, ' ') as phrase from lowest left join longer on longer.lang = lowest.lang and q = p where most is null or 100 * most < 50 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from alone)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000"""


@query("op13_phrase_collocations", _PHRASE_SQL)
def _(spark, read):
    """Each language's best phrases of two or three words."""
    return phrases.collocations(read("documents").select("text", "lang"))
