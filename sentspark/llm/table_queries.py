"""Queries of the operators that work by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sentspark.llm.feistel import ROUNDS, SEED, shard_rows
from sentspark.llm.registry import query, table
from sentspark.llm.soft_mixing import document_rates, fit, reached_shares
from sentspark.llm.surrogates import replace_entities
from sentspark.llm.url_reputation import LIMIT, LONG_SUFFIXES, RULES, STRENGTH, Z, judge_urls


_LONG = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)


def _prior_sql(name: str, children: str, parent: str) -> str:
    """CTE ``name`` (parent, pn, pbad, strength): the moments over ``children``."""
    low, high = STRENGTH
    return f"""{name}_sums AS (SELECT {parent} AS parent, sum(n) AS pn, sum(bad) AS pbad, count(*) AS k, sum(n * n) AS nn, sum(bad * bad / n) AS bb
        FROM {children} WHERE n > 0 GROUP BY 1),
    {name}_room AS (SELECT *, pbad / pn AS m, pn - nn / pn AS room FROM {name}_sums),
    {name}_between AS (SELECT *, CASE WHEN room > 0 THEN (bb - pn * m * m - (k - 1) * m * (1 - m)) / room END AS between_ FROM {name}_room),
    {name} AS (SELECT parent, pn, pbad, greatest({low}, least({high}, CASE WHEN between_ > 0 THEN m * (1 - m) / between_ - 1 ELSE {high} END)) AS strength
        FROM {name}_between)"""


def _rules_sql() -> tuple[str, str]:
    rule, verdict = "", ""
    for text, what in sorted(RULES, key=lambda r: -len(r[0])):
        domain, slash, rest = text.partition("/")
        fits = f"(host = '{domain}' OR ends_with(host, '.{domain}'))" + (f" AND starts_with(path, '/{rest}')" if rest else "")
        rule, verdict = rule + f" WHEN {fits} THEN '{text}'", verdict + f" WHEN {fits} THEN '{what}'"
    return f"CASE{rule} END", f"CASE{verdict} ELSE method END"


_OP1_SQL = f"""WITH
    rest AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) AS path,
        TRY_CAST(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]{{1,18}})', 1) AS BIGINT) AS doc_id FROM rest),
    outcomes AS (SELECT page_id, quality = 0 OR toxic = 1 AS is_bad FROM parts JOIN labels USING (doc_id)),
    counted AS (SELECT page_id, count(*)::DOUBLE AS n, sum(is_bad::INTEGER)::DOUBLE AS bad FROM outcomes WHERE is_bad IS NOT NULL GROUP BY 1),
    hosts AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM parts LEFT JOIN counted USING (page_id) GROUP BY 1),
    labels_of AS (SELECT *, string_split(host, '.') AS l FROM hosts),
    last_two AS (SELECT *, array_to_string(l[greatest(1, len(l) - 1):], '.') AS two, array_to_string(l[greatest(1, len(l) - 2):], '.') AS three FROM labels_of),
    levels AS (SELECT host, n, bad, CASE WHEN two IN ({_LONG}) THEN three ELSE two END AS domain,
        CASE WHEN two IN ({_LONG}) THEN two ELSE l[len(l)] END AS suffix FROM last_two),
    domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM levels GROUP BY 1, 2),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1),
    {_prior_sql("top", "suffixes", "0")}, {_prior_sql("by_suffix", "domains", "suffix")}, {_prior_sql("by_domain", "levels", "domain")},
    start AS (SELECT coalesce(max(pbad / pn), 0.5) AS rate, coalesce(max(strength), {STRENGTH[0]}) AS s FROM top),
    suffix_rates AS (SELECT suffix, (bad + s * rate) / (n + s) AS suffix_rate FROM suffixes, start),
    domain_rates AS (SELECT domain, (bad + coalesce(strength, {STRENGTH[1]}) * suffix_rate) / (n + coalesce(strength, {STRENGTH[1]})) AS domain_rate
        FROM domains JOIN suffix_rates USING (suffix) LEFT JOIN by_suffix ON parent = suffix),
    means AS (SELECT host, (bad + coalesce(strength, {STRENGTH[1]}) * domain_rate) / (n + coalesce(strength, {STRENGTH[1]})) AS m,
        n + coalesce(strength, {STRENGTH[1]}) AS total FROM levels JOIN domain_rates USING (domain) LEFT JOIN by_domain ON parent = domain),
    bounds AS (SELECT host, m, greatest(0, m - {Z} * sqrt(m * (1 - m) / (total + 1))) AS b FROM means),
    judged AS (SELECT host, round(m, 9) AS posterior, round(b, 9) AS bound, CASE WHEN b > {LIMIT} THEN 'block' ELSE 'allow' END AS method FROM bounds)
    SELECT page_id, host, path, {_rules_sql()[0]} AS rule, {_rules_sql()[1]} AS verdict, posterior, bound FROM parts JOIN judged USING (host)"""


@query("op1_url_reputation", _OP1_SQL)
def op1_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """The number in a page's path names the document it shows, whose label is the
    page's outcome: bad if of low quality or toxic."""
    pages = table(spark, folder, "pages")
    shown = F.try_to_number(F.regexp_extract("url", r"://[^/?#]*/[a-z]+/(\d{1,18})", 1), F.lit("999999999999999999")).cast("long")
    outcomes = (
        pages.select("page_id", shown.alias("doc_id"))
        .join(table(spark, folder, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")), "doc_id")
        .select("page_id", "bad")
    )
    return judge_urls(pages, outcomes)


def _op5_sql(shards: int = 40) -> str:
    """The permutation by definition. CRC-32 goes over the hex digits of the bytes, the
    low one first, with the sixteen remainders of its polynomial."""
    remainders = []
    for nibble in range(16):
        for _ in range(4):
            nibble = (nibble >> 1) ^ (0xEDB88320 if nibble & 1 else 0)
        remainders.append(nibble)
    crc = (f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(1, len(h)), lambda j: "
           f"(strpos('0123456789ABCDEF', h[CASE WHEN j % 2 = 1 THEN j + 1 ELSE j - 1 END]) - 1)::BIGINT)), "
           f"lambda c, d: xor(c >> 4, ({remainders}::BIGINT[])[(xor(c, d) & 15) + 1]))")

    def round_(value: str, i: int) -> str:
        return f"('0x' || substr(md5('{SEED}:{i}:' || ({value})), 1, 8))::BIGINT"

    def network(x: str) -> str:
        """One pass as a chain of scalar subqueries over l and r."""
        sql = f"SELECT ({x}) // b AS l, ({x}) % b AS r"
        for i in range(ROUNDS):
            left, right = (f"(l + {round_('r', i)}) % a", "r") if i % 2 == 0 else ("l", f"(r + {round_('l', i)}) % b")
            sql = f"SELECT {left} AS l, {right} AS r FROM ({sql})"
        return f"(SELECT l * b + r FROM ({sql}))"

    return f"""WITH RECURSIVE
    bytes AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
    sums AS (SELECT doc_id, size, CASE WHEN size = 16 THEN 0 ELSE xor({crc}, 4294967295) END AS text_crc32 FROM bytes),
    numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS number, count(*) OVER () AS n FROM sums),
    sides AS (SELECT *, greatest(1, floor(sqrt(n)))::BIGINT AS a FROM numbered),
    both_sides AS (SELECT *, greatest(1, (n + a - 1) // a)::BIGINT AS b FROM sides),
    walk AS (SELECT number, n, a, b, {network("number")} AS x FROM both_sides
        UNION ALL SELECT number, n, a, b, {network("x")} FROM walk WHERE x >= n),
    landed AS (SELECT number, x FROM walk WHERE x < n)
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (x % {shards})::INTEGER AS shard, (x // {shards})::BIGINT AS slot,
        NULL::INTEGER AS grown_shard FROM both_sides JOIN landed USING (number)"""


@query("op5_feistel_shards", _op5_sql())
def op5_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard_rows(table(spark, folder, "documents"), shards=40)


@query("op9_surrogates")
def op9_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return replace_entities(table(spark, folder, "documents").select("doc_id", "text"))


# Target shares of the tokens of a mix, by what the label table says of a document.
MIX = {"clean": 0.88, "junk": 0.05, "toxic": 0.07}


def label_domains(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and domain of the labelled documents."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return table(spark, folder, "labels").select("doc_id", domain.alias("domain"))


@query("op7_soft_mixing")
def op7_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit(docs, label_domains(spark, folder))
    mixed = document_rates(docs, model, MIX, anchor="clean")
    shares = [F.round(F.element_at("p", i + 1), 9).alias(f"p_{d}") for i, d in enumerate(model.domains)]
    # What the rates reach of the targets, the same on every row.
    reached = [F.lit(round(x, 6)).alias(f"reached_{d}") for d, x in reached_shares(mixed, model).items()]
    return mixed.select("doc_id", "tokens", *shares, F.round("rate", 9).alias("rate"), "copies", *reached)
