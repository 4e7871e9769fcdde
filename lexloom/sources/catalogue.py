"""The catalogue of known sites: for each, where its payloads and pages keep a listing, as data.

A site is one entry of fixed values; the functions below read payloads of any mix of sites with one
expression for each, so a new site is a new entry.  Fetching stays outside (see ``readers``).
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsers
from ..functions import text as t

UNKNOWN = "Не указано"
REMOTE = "(?iu)remote|удален"

# Sites that answer searches with JSON.  search: where to ask ({q} the query, {c} the cursor); begin: the first
# cursor; after: how the next one follows (page, offset, or the parameter of a link); items: the list, and one: the item inside it; id, title,
# summary, published: paths in an item; url: of its page; detail: where to ask for more (none: the item is all); at: the object
# there; then the paths of a listing's fields; closed: a path with the value that closes it (none: any value does).
SITES: dict[str, dict] = {
    "ozon": {"hosts": ["job.ozon.ru"], "search": "https://job.ozon.ru/api/vacancies?query={q}&page={c}", "begin": "1", "after": "page", "items": "$.items", "id": ["$.id"], "title": "$.title", "summary": "$.summary", "published": "$.publishedAt", "url": "https://job.ozon.ru/vacancy/{id}", "detail": "https://job.ozon.ru/api/vacancies/{id}", "employer": "Ozon", "area": "$.location", "description": ["$.description"], "skills": ("names", "$.skills"), "remote": "$.workFormat", "closed": ("$.status", "closed")},
    "mts": {"hosts": ["job.mts.ru"], "search": "https://job.mts.ru/api/vacancies?search={q}&offset={c}", "begin": "0", "after": "offset", "items": "$.results", "id": ["$.slug", "$.id"], "title": "$.title", "summary": "$.shortDescription", "published": "$.publishedAt", "url": "https://job.mts.ru/vacancy/{id}", "detail": "https://job.mts.ru/api/vacancies/{id}", "employer": "МТС", "area": "$.city", "description": ["$.description"], "skills": ("list", "$.skills"), "remote": "$.workFormat", "closed": ("$.archivedAt", None)},
    "magnit": {"hosts": ["rabota.magnit.ru"], "search": "https://rabota.magnit.ru/api/vacancies?text={q}&page={c}", "begin": "1", "after": "page", "items": "$.vacancies", "id": ["$.id"], "title": "$.name", "summary": "$.preview", "published": "$.createdAt", "url": "https://rabota.magnit.ru/vacancy/{id}", "detail": "https://rabota.magnit.ru/api/vacancies/{id}", "employer": "Магнит", "area": "$.city", "description": ["$.description"], "skills": ("text", "$.requirements"), "remote": "$.workFormat", "closed": ("$.active", "false")},
    "rwb": {"hosts": ["career.wb.ru"], "search": "https://career.wb.ru/api/v1/vacancies?search={q}&page={c}", "begin": "1", "after": "page", "items": "$.data.items", "id": ["$.id"], "title": "$.name", "summary": "$.description", "published": "$.publishedAt", "url": "https://career.wb.ru/vacancies/{id}", "detail": "https://career.wb.ru/api/v1/vacancies/{id}", "at": "$.data", "employer": "RWB", "area": "$.city", "description": ["$.description"], "skills": ("text", "$.requirements"), "remote": "$.format", "closed": ("$.status", "archived")},
    "sber": {"hosts": ["career.sber.ru"], "search": "https://career.sber.ru/api/vacancies?query={q}&offset={c}", "begin": "0", "after": "offset", "items": "$.data", "id": ["$.id"], "title": "$.title", "summary": "$.shortDescription", "published": "$.publishedAt", "url": "https://career.sber.ru/vacancy/{id}", "employer": "Сбер", "area": "$.city", "description": ["$.description", "$.markdown"], "skills": ("list", "$.skills"), "remote": "$.format", "closed": ("$.status", "closed")},
    "selectel": {"hosts": ["careers.selectel.ru"], "search": "https://careers.selectel.ru/api/vacancies", "begin": "", "after": None, "items": "$.vacancies", "id": ["$.slug"], "title": "$.title", "summary": "$.description", "published": "$.publishedAt", "url": "https://careers.selectel.ru/vacancies/{id}", "employer": "Selectel", "area": "$.location", "description": ["$.description"], "skills": ("list", "$.skills"), "remote": "$.format", "closed": ("$.active", "false"), "words": 1},
    "yadro": {"hosts": ["careers.yadro.com"], "search": "https://careers.yadro.com/api/vacancies?query={q}&page={c}", "begin": "1", "after": None, "items": "$.items", "id": ["$.id"], "title": "$.title", "summary": "$.description", "published": "$.publishedAt", "url": "https://careers.yadro.com/vacancy/{id}", "employer": "YADRO", "area": "$.location", "description": ["$.description"], "skills": ("list", "$.skills"), "remote": "$.format", "closed": ("$.status", "closed")},
    "trudvsem": {"hosts": ["opendata.trudvsem.ru", "trudvsem.ru"], "search": "https://opendata.trudvsem.ru/api/v1/vacancies/region/{region}?text={q}&offset={c}", "begin": "0", "after": "offset", "items": "$.results.vacancies", "one": "$.vacancy", "id": ["$.id"], "title": "$['job-name']", "summary": "$.duty", "published": "$['creation-date']", "url": "https://trudvsem.ru/vacancy/card/{id}", "employer_at": "$.company.name", "area": "$.region.name", "description": ["$.duty"], "skills": ("text", "$.requirement.qualification"), "remote": "$['work-place']", "closed": ("$['vacancy-status']", "closed")},
    "yandex": {"hosts": ["yandex.ru"], "search": "https://yandex.ru/jobs/api/jobs/publications?text={q}&cursor={c}", "begin": "", "after": "cursor", "items": "$.items", "id": ["$.id"], "title": "$.title", "summary": "$.shortDescription", "published": "$.publishedAt", "url": "https://yandex.ru/jobs/vacancies/{id}", "page": True, "employer": "Яндекс", "area": "$.location", "skills": ("names", "$.skills"), "remote": "$.workFormat"},
    "vk": {"hosts": ["team.vk.company"], "search": "https://team.vk.company/career/api/v2/vacancies/?search={q}&offset={c}", "begin": "", "after": "offset=", "items": "$.results", "id": ["$.id"], "title": "$.title", "summary": "$.description", "published": "$.published_at", "url": "https://team.vk.company/vacancy/{id}", "page": True, "employer": "VK", "area": "$.city", "skills": ("names", "$.skills"), "remote": "$.work_format"},
    "tbank": {"hosts": ["www.tbank.ru"], "search": "https://www.tbank.ru/api/common/v1/graphql", "begin": "0", "after": "offset", "items": "$.data.vacancies.items", "id": ["$.id"], "title": "$.title", "summary": "$.summary", "published": "$.publishedAt", "url": "https://www.tbank.ru/career/{group}/vacancies/{slug}", "slug": ["$.slug", "$.id"], "employer": "Т-Банк", "area": "$.location", "description": ["$.description", "$.content"], "skills": ("list", "$.skills"), "remote": "$.workFormat", "closed": ("$.status", "closed"), "words": 2},
}

# Sites whose listings are pages of links: where a page is ({page} its number), and the links on it.
BOARDS: dict[str, dict] = {
    "habr": {"hosts": ["career.habr.com"], "listing": "https://career.habr.com/vacancies?page={page}", "link": r"(?is)<a\b[^>]*href=[\"'](/vacancies/\d+)[\"'][^>]*>(.*?)</a>(?:.{0,500}?<time[^>]*>(.*?)</time>)?"},
    "rabota": {"hosts": ["www.rabota.ru"], "listing": "https://www.rabota.ru/vacancy/?page={page}", "link": r"(?is)<a\b[^>]*href=[\"'](/vacancy/[^\"']+)[\"'][^>]*>(.*?)</a>()"},
    "hirehi": {"hosts": ["hirehi.ru", "www.hirehi.ru"], "listing": "https://hirehi.ru/vacancies/{specialization}?query={q}&page={page}", "link": r"(?is)<a\b[^>]*href=[\"'](/vacancies/[^\"']+/\d+)[\"'][^>]*>(.*?)</a>()"},
    "geekjob": {"hosts": ["geekjob.ru"], "listing": "https://geekjob.ru/vacancies?page={page}", "link": r"(?is)<a\b[^>]*href=[\"'](/vacancy/[^\"']+)[\"'][^>]*>(.*?)</a>()"},
    "avito": {"hosts": ["www.avito.ru"], "listing": "https://www.avito.ru/rossiya/vakansii?p={page}", "link": r"(?is)<a\b[^>]*href=[\"'](/[^\"']*/vakansii/[^\"']+)[\"'][^>]*>(.*?)</a>()"},
    "kontur": {"hosts": ["kontur.ru"], "listing": "https://kontur.ru/career/vacancies", "link": r"(?is)<a\b[^>]*href=[\"'](/career/vacancies/[^\"']+)[\"'][^>]*>(.*?)</a>()"},
    "kaspersky": {"hosts": ["careers.kaspersky.ru"], "listing": "https://careers.kaspersky.ru/vacancies?search={q}&page={page}", "link": r"(?is)<a\b[^>]*href=[\"'](/vacancies/[^\"']+)[\"'][^>]*>(.*?)</a>()"},
}

#: All sites in the order in which they are registered; "ats" stands for the job boards of ``readers.BOARDS``.
ORDER = ["habr", "rabota", "hirehi", "geekjob", "avito", "trudvsem", "ats", "yandex", "ozon", "rwb", "mts", "vk", "kontur", "magnit", "yadro", "selectel", "sber", "kaspersky", "tbank"]
SPECIALIZATIONS = ["development", "analytics", "management", "design", "marketing", "support"]


def search_url(site: str, query: str, cursor: str | None = None, region: str = "7700000000") -> str:
    """Where a search of a JSON site asks for its next page."""
    if not region.isdecimal() or len(region) != 10:
        raise ValueError("a region is ten digits")
    spec = SITES[site]
    return spec["search"].format(q=quote(query, safe=""), c=cursor if cursor is not None else spec["begin"], region=region)


def listing_url(site: str, page: int = 1, query: str = "", specialization: str = SPECIALIZATIONS[0]) -> str:
    if specialization not in SPECIALIZATIONS:
        raise ValueError(f"no specialization {specialization}")
    return BOARDS[site]["listing"].format(page=page, q=quote(query, safe=""), specialization=specialization)


def _first(value: Column, paths: list[str]) -> Column:
    """The first text at the paths that is not blank."""
    return F.coalesce(*[F.nullif(parsers.text_at(value, p), F.lit("")) for p in paths], F.lit(""))


def _filled(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def _date(value: Column, path: str) -> Column:
    return F.try_to_timestamp(parsers.text_at(value, path)).cast("timestamp_ntz")


def listings(payloads: DataFrame, group: str = "technology") -> DataFrame:
    """Listings of landed pages (site, search_name, query, payload as JSON text): source, source_id, url, title, summary, published_at, search_name, payload.

    Items without an identifier or title are passed over.  Sites that list everything are searched here: all words of
    the query (those of enough letters) stand in the title.
    """
    out = None
    for site, spec in SITES.items():
        page = payloads.filter(F.col("site") == site)
        items = page.select("search_name", "query", F.explode(F.try_variant_get(F.try_parse_json("payload"), spec["items"], "array<variant>")).alias("item"))
        if "one" in spec:
            items = items.withColumn("item", F.coalesce(F.try_variant_get("item", spec["one"], "variant"), F.col("item")))
        item = F.col("item")
        number, title = _first(item, spec["id"]), F.coalesce(parsers.text_at(item, spec["title"]), F.lit(""))
        url = _filled(spec["url"], id=number, slug=F.url_encode(_first(item, spec["slug"])) if "slug" in spec else number, group=F.lit(group))
        found = items.select(F.lit(site).alias("source"), number.alias("source_id"), url.alias("url"), title.alias("title"), F.coalesce(parsers.text_at(item, spec["summary"]), F.lit("")).alias("summary"), _date(item, spec["published"]).alias("published_at"), "search_name", F.to_json(item).alias("payload"), "query")
        found = found.filter((F.col("source_id") != "") & (F.col("title") != ""))
        if "words" in spec:
            words = F.filter(F.split(F.lower(F.col("query")), r"\s+"), lambda w, least=spec["words"]: F.length(w) >= least)
            found = found.filter((F.size(words) > 0) & F.forall(words, lambda w: F.lower(F.col("title")).contains(w)))
        out = found.drop("query") if out is None else out.unionByName(found.drop("query"))
    return out


def next_cursors(payloads: DataFrame) -> DataFrame:
    """site, search_name, next_cursor of landed pages (site, search_name, cursor, payload); null after the last one."""
    out = None
    for site, spec in SITES.items():
        page = payloads.filter(F.col("site") == site)
        payload, after = F.try_parse_json("payload"), spec["after"]
        n = F.coalesce(F.size(F.try_variant_get(payload, spec["items"], "array<variant>")), F.lit(0))
        here = F.coalesce(F.nullif(F.col("cursor"), F.lit("")), F.lit(spec["begin"] or "0")).try_cast("long")
        if after in ("page", "offset"):
            following = F.when(n > 0, (here + (F.lit(1) if after == "page" else n)).cast("string"))
        elif after:
            link = parsers.text_at(payload, "$.next")
            following = F.nullif(F.coalesce(F.nullif(F.parse_url(F.when(link.rlike("^https?://"), link).otherwise(F.concat(F.lit("https://x"), link)), F.lit("QUERY"), F.lit(after.rstrip("="))), F.lit("")), link), F.lit(""))
        else:
            following = F.lit(None).cast("string")
        found = page.select("site", "search_name", following.alias("next_cursor"))
        out = found if out is None else out.unionByName(found)
    return out


def _skills(item: Column, kind: str, path: str) -> Column:
    if kind == "text":
        found = F.split(F.coalesce(parsers.text_at(item, path), F.lit("")), "[,;]")
    else:
        values = F.try_variant_get(item, path, "array<variant>")
        found = F.transform(values, lambda x: parsers.text_at(x, "$.name" if kind == "names" else "$"))
    return F.slice(F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), 1, 30)


def vacancies(details: DataFrame, minimum_text: int = 20) -> DataFrame:
    """Landed details (site, source_id, title, url, published_at, search_name, payload) as listings with a status.

    ok, closed, or invalid where the title or enough text is missing.  Sites whose detail is a page are read by
    ``readers.company_pages``.
    """
    out = None
    for site, spec in SITES.items():
        if "page" in spec:
            continue
        rows = details.filter(F.col("site") == site).withColumn("v", F.try_variant_get(F.try_parse_json("payload"), spec.get("at", "$"), "variant"))
        v = F.col("v")
        text = lambda path: F.coalesce(parsers.text_at(F.col("v"), path), F.lit(""))
        path, value = spec["closed"]
        closed = text(path) != "" if value is None else text(path) == value
        if site == "tbank":
            closed = closed | (text("$.archivedAt") != "")
        name = F.coalesce(F.nullif(text(spec["title"]), F.lit("")), F.col("title"), F.lit(""))
        body = t.html_text(_first(v, spec["description"]))
        employer = text(spec["employer_at"]) if "employer_at" in spec else F.lit(spec["employer"])
        status = F.when(closed, "closed").when((F.trim(name) != "") & (F.length(body) >= minimum_text), "ok").otherwise("invalid")
        found = rows.select(
            F.lit(site).alias("source"), "source_id", "url", "search_name", status.alias("status"), F.trim(name).alias("title"), body.alias("description"),
            F.coalesce(F.nullif(employer, F.lit("")), F.lit(UNKNOWN)).alias("employer"), F.coalesce(F.nullif(text(spec["area"]), F.lit("")), F.lit(UNKNOWN)).alias("area"),
            _skills(v, *spec["skills"]).alias("key_skills"), F.when(text(spec["remote"]).rlike(REMOTE), "remote").otherwise("unspecified").alias("work_format"),
            F.coalesce(_date(v, spec["published"]), F.col("published_at")).alias("published_at"),
        )
        out = found if out is None else out.unionByName(found)
    return out


def board_listings(pages: DataFrame, now) -> DataFrame:
    """Listings of landed pages (site, html): source, source_id, url, title, published_at.

    Postings in a page's linked data come first, then its links; one of each identifier, which is the last part of the address.
    """
    out = None
    for site, spec in BOARDS.items():
        base = F.lit("https://" + spec["hosts"][0])
        page = pages.filter(F.col("site") == site).select("html")
        told = page.select(F.monotonically_increasing_id().alias("page"), F.posexplode(parsers.postings("html")).alias("place", "x"))
        told = told.select(F.get_json_object("x", "$.url").alias("link"), t.plain_text(F.get_json_object("x", "$.title")).alias("title"), F.try_to_timestamp(F.get_json_object("x", "$.datePosted")).cast("timestamp_ntz").alias("published_at"), F.lit(0).alias("rank"))
        groups = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(spec["link"]), F.lit(k)).alias(n) for k, n in ((1, "link"), (2, "title"), (3, "date"))])
        linked = page.select(F.explode(groups).alias("x")).select(F.col("x.link").alias("link"), t.html_text(F.col("x.title")).alias("title"), parsers.russian_date(t.html_text(F.col("x.date")), now).alias("published_at"), F.lit(1).alias("rank"))
        rows = told.unionByName(linked)
        whole = F.when(F.col("link").rlike("^https?://"), F.col("link")).otherwise(F.concat(base, F.col("link")))
        number = F.element_at(F.filter(F.split(F.regexp_replace(whole, r"^https?://[^/]*|[?#].*$", ""), "/"), lambda x: x != ""), -1)
        rows = rows.withColumns({"url": whole, "source_id": F.when(F.regexp_replace(whole, r"^https?://[^/]*/?", "") != "", number)}).filter((F.col("title") != "") & F.col("source_id").isNotNull())
        found = rows.groupBy("source_id").agg(F.min(F.struct("rank", "url", "title", "published_at")).alias("x")).select(F.lit(site).alias("source"), "source_id", "x.url", "x.title", "x.published_at")
        out = found if out is None else out.unionByName(found)
    return out
