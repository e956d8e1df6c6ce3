"""Sites made of the given pages, and the same parse, link types and scores in SQL for DuckDB.

The given pages link to their own words only; here each gets a menu, contact details and a description by its key.
"""

from __future__ import annotations

#: (modulus, remainder, href, label) of the links that a page's menu gets.
MENU = (
    (2, 1, "/about-us", "About"),
    (3, 1, "/our-services?x=1", "What we do"),
    (4, 2, "https://www.facebook.com/shop", "us"),
    (5, 2, "/book-now", "Book"),
    (5, 3, "https://other.example.org/contact", "elsewhere"),
    (6, 1, "/x", "Contact"),
    (7, 2, "/jobs", "Careers"),
    (3, 2, "/news", "Blog &amp; press"),
    (7, 3, "/price-list", "Prices"),
    (4, 1, "https://cal.example.org/x", "Free estimate"),
    (8, 3, "/about-us", "Our story"),
    (8, 5, "/jobs", "The team"),
    (9, 4, "tel:+12125550199", "Call"),
    (9, 5, "mailto:a@b.example", "Mail"),
)
_LINKS = ", ".join(f"case when page_id % {m} = {r} then '<a href=\"{h}\">{t}</a> ' else '' end" for m, r, h, t in MENU)
_BODY = f"concat('<body>', {_LINKS}, case when page_id % 5 = 1 then '<p>Ring (212) 555-0199.</p>' else '' end, case when page_id % 6 = 1 then '<p>mail shop@site.example</p>' else '' end, case page_id % 8 when 1 then '<p>Read a review, see our  work.</p>' when 2 then '<p>Previews, uninsured.</p>' when 3 then '<p>Case studies; a case study, CERTIFIED</p>' when 4 then '<p>Licensed. Portfolios! Call now, call</p>' else '' end)"
_HEAD = "concat('</title>', case when page_id % 3 = 0 then '<meta name=\"viewport\" content=\"width=device-width\">' else '' end, case when page_id % 4 <> 1 then '<meta name=\"description\" content=\" A page of Thon \">' else '' end)"
#: An expression over page_id and html that both engines read alike.
SITE_HTML = f"replace(replace(html, '<body>', {_BODY}), '</title>', {_HEAD})"
#: A short page for each page, which leads to it or, for a third of them, to another site.
MOVED = 1_000_000_000
MOVED_URL = "concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), '/old')"
MOVED_HTML = "concat('<html><head><meta http-equiv=\"refresh\" content=\"0; url=', case when page_id % 3 = 0 then 'https://elsewhere.example.org/' else url end, '\"></head><body>Moved.</body></html>')"

_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
_decoded = "replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')".format
_squeezed = lambda x: f"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'))"
_visible = lambda x: _squeezed(_decoded(x=f"regexp_replace({x}, '</?[a-zA-Z][^>]*>', ' ', 'g')"))
_bare = r"regexp_replace(regexp_replace(substr(h, strpos(h, '<body>') + 6), '<!--.*?-->', '', 'gs'), '</?(a|b)( [^>]*)?>', '', 'g')"


def parsed(html: str) -> str:
    """Common table expressions up to ``p``: what one parse of the given pages gives."""
    return rf"""src AS (SELECT page_id, url, {html} AS h FROM pages),
bare AS (SELECT *, {_bare} AS b FROM src),
txt AS (SELECT page_id, url, h, nullif({_squeezed(_decoded(x="regexp_extract(h, '<title>(.*?)</title>', 1, 's')"))}, '') AS title,
    nullif(trim(regexp_extract(h, '<meta name="description" content="([^"]*)">', 1)), '') AS descr, {_visible('b')} AS text,
    {_visible("regexp_replace(b, '<nav>.*?</nav>|<footer>.*?</footer>', ' ', 'gs')")} AS content FROM bare),
p AS (SELECT *, len([x FOR x IN string_split(text, ' ') IF regexp_matches(x, '[\p{{L}}\p{{N}}]')]) AS words FROM txt)"""


#: (page_id, url, ord, href, label, type) of the first 30 links of ``src``.
LINKS = r"""pair AS (SELECT page_id, url, regexp_extract_all(h, '<a href="([^"]*)">[^<]*</a>', 1) AS hs, regexp_extract_all(h, '<a href="[^"]*">([^<]*)</a>', 1) AS ls FROM src),
flat AS (SELECT page_id, url, unnest(range(1, len(hs) + 1)) AS k, unnest(hs) AS href, unnest(ls) AS label FROM pair),
web AS (SELECT page_id, url, k, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) ELSE '' END || replace(href, '&amp;', '&') AS href, left(trim(replace(label, '&amp;', '&')), 60) AS label FROM flat WHERE regexp_matches(href, '^(/|https?://)')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS ord FROM web QUALIFY ord < 30),
cut AS (SELECT *, regexp_replace(lower(regexp_extract(href, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS hh, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS uh,
    ' ' || regexp_replace(lower(regexp_extract(href, '^https?://[^/?#]+([^#]*)', 1) || ' ' || label), '[^a-z0-9]+', ' ', 'g') || ' ' AS w FROM numbered),
own AS (SELECT *, hh = uh OR ends_with(hh, '.' || uh) OR ends_with(uh, '.' || hh) AS o FROM cut),
links AS (SELECT page_id, url, ord, href, hh, uh, CASE WHEN regexp_matches(hh, '(^|\.)(facebook|fb|instagram|linkedin|youtube|x|twitter|tiktok)\.com$') AND length(w) > 2 THEN 'social'
    WHEN regexp_matches(w, ' (book|booking|schedule|appointments?) ') THEN 'booking' WHEN regexp_matches(w, ' (quotes?|estimates?) ') THEN 'quote'
    WHEN o AND w LIKE '% contact %' THEN 'contact' WHEN o AND regexp_matches(w, ' (pricing|prices|packages) ') THEN 'pricing' WHEN o AND regexp_matches(w, ' services? ') THEN 'services'
    WHEN o AND regexp_matches(w, ' (about|team|our story|who we are) ') THEN 'about' WHEN o AND regexp_matches(w, ' (blog|news|press|articles) ') THEN 'blog'
    WHEN o AND regexp_matches(w, ' (careers?|jobs|join our team|employment) ') THEN 'careers' ELSE 'other' END AS type FROM own)"""

_PHONE = r"(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_SITE = f"WITH {parsed(SITE_HTML)}"
_CONTACT = f"contains(h, 'href=\"tel:') OR regexp_matches(text, '{_PHONE}') AS has_phone, contains(h, 'href=\"mailto:') OR regexp_matches(text, '{_EMAIL}') AS has_email"

PAGE_TEXT = f"WITH {parsed('html')} SELECT page_id, title, words::INTEGER AS word_count, length(text)::INTEGER AS text_chars, length(content)::INTEGER AS content_chars FROM p"
CLASSIFY_LINKS = f"{_SITE}, {LINKS} SELECT type, count(*) AS n FROM links GROUP BY type"
CONTACT_FLAGS = f"{_SITE} SELECT page_id, {_CONTACT} FROM p"
PAGES_TO_FOLLOW = f"""{_SITE}, {LINKS},
first AS (SELECT page_id, type, list_position(['about', 'services', 'careers', 'blog', 'contact'], type) AS t, arg_min(href, ord) AS href FROM links WHERE hh = uh AND type IN ('about', 'services', 'careers', 'blog', 'contact') GROUP BY page_id, type),
once AS (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY t) = 1)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY t)::INTEGER AS place, type, href FROM once QUALIFY place <= 2"""
AUDIT_GATE = f"""WITH {parsed('html')} SELECT page_id, CASE WHEN words >= 40 THEN page_id END AS audited_page_id, CASE WHEN words >= 40 THEN 'ok' ELSE 'insufficient_content' END AS status FROM p
UNION ALL SELECT page_id + {MOVED}, CASE WHEN words >= 40 AND page_id % 3 <> 0 THEN page_id END, CASE WHEN words >= 40 AND page_id % 3 <> 0 THEN 'ok' ELSE 'insufficient_content' END FROM p"""

_times = lambda k: f"len(regexp_extract_all(' ' || regexp_replace(lower(text), '([^a-z0-9])', '\\1\\1', 'g') || ' ', '[^a-z0-9]{k}s?[^a-z0-9]'))"
_when = lambda n, c: f"CASE WHEN {c} THEN {n} ELSE 0 END"
_has = lambda *t: "(" + " OR ".join(f"list_contains(types, '{x}')" for x in t) + ")"
_any = lambda *ks: " OR ".join(f"{_times(k)} > 0" for k in ks)
TEXT_FLAGS = f"{_SITE} SELECT page_id, ({_times('call')} + {_times('book +now')})::INTEGER AS cta_count, {_any('testimonial', 'review', 'case +study')} AS has_testimonials, {_any('certified', 'licensed', 'insured', 'award', 'guaranteed', 'trusted')} AS has_trust, {_any('gallery', 'case +study', 'portfolio', 'our +work')} AS has_gallery FROM p"
#: Common table expressions up to ``scored``: the five categories of each page and their sum.
SCORED = f"""{_SITE}, {LINKS}, kinds AS (SELECT page_id, list(DISTINCT type) AS types FROM links GROUP BY page_id),
flags AS (SELECT p.*, coalesce(types, []) AS types, {_CONTACT}, lower(coalesce(title, '') || ' ' || coalesce(descr, '') || ' ' || text) AS hay FROM p LEFT JOIN kinds USING (page_id)),
cats AS (SELECT page_id, url, words,
    {_when(5, "title IS NOT NULL")} + {_when(5, "descr IS NOT NULL")} + {_when(5, "regexp_matches(h, '<h1[ >]')")} + {_when(5, "words >= 300")} + {_when(5, "contains(hay, 'tion') OR contains(hay, 'thon')")} AS seo,
    {_when(8, _times('the') + " >= 2")} + {_when(7, "has_phone OR has_email")} + {_when(5, _has('contact', 'booking', 'quote'))} + {_when(5, _has('services', 'pricing'))} AS conversion,
    {_when(8, _times('of') + " > 0")} + {_when(4, _times('and') + " > 0")} + {_when(4, _has('about'))} + {_when(4, _times('that') + " > 0")} AS trust,
    {_when(8, _has('services'))} + {_when(4, _has('blog'))} + {_when(4, "len(regexp_extract_all(h, '<h[1-6][ >]')) >= 3")} + {_when(4, "contains(hay, 'thon')")} AS content,
    {_when(3, "contains(h, 'name=\"viewport\"')")} + {_when(3, "page_id % 5000 < 2500")} + {_when(2, "strlen(h) < 1048576")} + {_when(2, "url LIKE 'https:%'")} AS technical FROM flags),
scored AS (SELECT *, seo + conversion + trust + content + technical AS website_score FROM cats)"""
WEBSITE_SCORE = f"{SCORED} SELECT page_id, seo::INTEGER AS seo, conversion::INTEGER AS conversion, trust::INTEGER AS trust, content::INTEGER AS content, technical::INTEGER AS technical, website_score::INTEGER AS website_score FROM scored"
RANKED_PAGES = f"""{SCORED}, f AS (SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS market_id, page_id, website_score, words >= 40 AS scored, CASE WHEN words >= 40 THEN CAST(floor(0.6e0 * website_score + 0.2e0 * 50 + 0.15e0 * 40 + 0.05e0 * 80 + 0.5e0) AS BIGINT) END AS final_score FROM scored),
r AS (SELECT *, scored AND count(*) FILTER (WHERE scored) OVER (PARTITION BY market_id) >= 2 AS ranked, rank() OVER (PARTITION BY market_id ORDER BY final_score DESC NULLS LAST) AS k, count(*) OVER (PARTITION BY market_id, final_score) AS same FROM f)
SELECT market_id, page_id, page_id = min(page_id) OVER (PARTITION BY market_id) AS is_user, website_score::INTEGER AS website_score, final_score, scored, CASE WHEN ranked THEN k END::INTEGER AS rank, ranked AND same > 1 AS tied FROM r"""

#: The pages' urls, and other spellings of them that are not fetched or not kept as they are.
URL_CASES = """CASE page_id % 13 WHEN 0 THEN replace(url, 'http', 'ftp') WHEN 1 THEN replace(url, '://', '://me:pw@') WHEN 2 THEN concat(split_part(url, '/', 1), '//', split_part(url, '/', 3), ':8080/x')
WHEN 3 THEN concat('http://10.1.2.', cast(page_id % 200 as varchar(9)), '/a') WHEN 4 THEN 'http://0x7f.1/' WHEN 5 THEN concat('HTTPS://', upper(split_part(url, '/', 3)), ':443/A?b=C') WHEN 6 THEN concat(' ', split_part(url, '/', 3), '/p ')
WHEN 7 THEN 'http://[::1]/' WHEN 8 THEN concat('http://db', cast(page_id as varchar(20)), '.internal/') WHEN 9 THEN 'https://8.8.8.8:443' WHEN 10 THEN concat('https://', split_part(url, '/', 3), ':80#f') ELSE url END"""
_U = f"WITH c AS (SELECT page_id, trim({URL_CASES}) AS u FROM pages), s AS (SELECT page_id, CASE WHEN contains(u, '://') THEN u ELSE 'https://' || u END AS u FROM c), m AS (SELECT page_id, lower(split_part(u, '://', 1)) AS scheme, regexp_extract(u, '://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]+)', 1) AS host0, regexp_matches(u, '://[^/?#]*@') AS cred, regexp_extract(u, '://[^/?#]*:([0-9]+)(?:[/?#]|$)', 1) AS port, regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '(\\?[^#]*)', 1) AS query, regexp_extract(u, '(#.*)$', 1) AS frag FROM s), v AS (SELECT *, lower(trim(host0, '[]')) AS host FROM m)"
NORMALIZE_URL = f"{_U} SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND NOT cred THEN scheme || '://' || host || CASE WHEN port = '' OR (scheme, port) IN (('https', '443'), ('http', '80')) THEN '' ELSE ':' || port END || CASE WHEN path = '' THEN '/' ELSE path END || query || frag END AS normal FROM v"
SCREEN_URLS = f"{_U} SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN cred THEN 'credentials' WHEN port NOT IN ('', '80', '443') THEN 'port' WHEN host LIKE '%.internal' THEN 'name' WHEN host LIKE '10.%' OR host IN ('0x7f.1', '::1') THEN 'address' END AS reason FROM v"
DESCRIBE_URL = r"WITH d AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') || url_decode(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1), '^/$', '')) AS s FROM pages) SELECT page_id, CASE WHEN length(s) > 72 THEN left(s, 71) || '…' ELSE s END AS shown FROM d"
NORMALIZE_NAME = r"WITH f AS (SELECT doc_id, regexp_replace(replace(regexp_replace(lower(strip_accents(text)), '[''\"`‘’“”]', '', 'g'), '&', ' and '), '[^a-z0-9]+', ' ', 'g') AS n FROM documents) SELECT doc_id, trim(regexp_replace(regexp_replace(n, '\b(inc|llc|ltd|co|corp|company|gmbh|limited|corporation)\b', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM f"
