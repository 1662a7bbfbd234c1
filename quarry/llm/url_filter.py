"""URL filter: host and path rules first, then a weighted vocabulary counted by one Aho-Corasick pass.

A term counts where no letter or digit touches it on either side (a-z, 0-9, other characters bound). One strict term
rejects a url, and so do ``soft_limit`` distinct soft ones. The automaton and the rules are small settings made on the
driver; each worker builds its automaton once.

Defined results: a null url has empty host and path, fits no rule and is allowed; repeated rows are judged each; a url of
any length is judged whole; of rules of one length the first given wins; an empty table gives no rows; columns besides
id and url are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, hide_null, map_batches, show_null, table

#: Our own vocabulary.
STRICT = ("porn", "porno", "xxx", "hentai", "camgirls", "sexcam", "escorts", "nudes", "milf", "bdsm", "warez", "viagra", "cialis")
SOFT = ("adult", "sex", "sexy", "nude", "naked", "erotic", "fetish", "dating", "hot", "casino", "poker", "betting", "slots", "torrent", "crack", "keygen", "pills", "payday", "loan", "replica")
#: Fixed values: (host, path, verdict) of the rules asked for.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

_automata: dict = {}


def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    if (strict, soft) not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for term in soft:
            a.add_word(term, (len(term), False, term))
        for term in strict:
            a.add_word(term, (len(term), True, term))
        a.make_automaton()
        _automata[strict, soft] = a
    return _automata[strict, soft]


def bounded_terms(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """(strict terms, distinct soft terms) that stand alone in the lower-case ``url``."""
    word = "abcdefghijklmnopqrstuvwxyz0123456789"
    hard, easy = 0, set()
    for end, (n, is_strict, term) in automaton(strict, soft).iter(url):
        if (end + 1 == len(url) or url[end + 1] not in word) and (end < n or url[end - n] not in word):
            if is_strict:
                hard += 1
            else:
                easy.add(term)
    return hard, len(easy)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = 2) -> DataFrame:
    """Per url: id, host, path, the longest fitting rule, verdict, n_strict, n_soft."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    plain = pages.select(hide_null(F.col(id_col)).alias(id_col), ascii_lower(host).alias("host"), path.alias("path"), ascii_lower(url).alias("url"))
    by_host: dict[str, list[tuple[str, str]]] = {}
    for h, p, verdict in rules:
        by_host.setdefault(h, []).append((p, verdict))

    def judged(host: str, path: str, url: str) -> tuple:
        best, verdict, at = None, None, 0
        while True:  # the host, then what stands behind each dot
            for p, v in by_host.get(host[at:], ()):
                if path.startswith(p) and (best is None or len(host) - at + len(p) > len(best)):
                    best, verdict = host[at:] + p, v
            if (dot := host.find(".", at)) < 0:
                break
            at = dot + 1
        hard, easy = bounded_terms(url, strict, soft)
        return best, verdict or ("block" if hard or easy >= soft_limit else "allow"), hard, easy

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [judged(*x) for x in zip(b["host"], b["path"], b["url"], strict=True)]
            out = pd.DataFrame(found, columns=["rule", "verdict", "n_strict", "n_soft"], index=b.index)
            yield pd.concat([b[[id_col, "host", "path"]], out], axis=1)

    out = map_batches(plain, judge, f"`{id_col}` long, host string, path string, rule string, verdict string, n_strict int, n_soft int")
    return out.select(show_null(id_col), *out.columns[1:])


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def _op5_sql() -> str:
    strict, soft = "|".join(STRICT), [f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT" for t in SOFT]
    cases = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in cases)
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in cases)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    once = f"(^|[^a-z0-9])({strict})($|[^a-z0-9])"
    # neighbouring terms may share a bound, so each is counted on a url whose bounds are doubled
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
b AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, {low.format("url")} AS u, {low.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM b),
d AS (SELECT *, CASE {rule} END AS rule, len(regexp_extract_all(regexp_replace(u, '([^a-z0-9])', '\\1\\1', 'g'), '{once}'))::INT AS n_strict,
  ({" + ".join(soft)})::INT AS n_soft FROM c)
SELECT page_id, host, path, rule, CASE {verdict} WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft FROM d
"""


OP5_SQL = _op5_sql()
