"""The word lists, patterns and constants that decide what a feed item, a role or boilerplate is."""

from __future__ import annotations

# Roles of JSON keys, after lower-casing and turning "-" and " " into "_".
ROLE_KEYS = {
    "title": "title name headline subject heading label post_title article_title caption".split(),
    "url": "url uri href link permalink canonical_url slug path web_url source_url full_url page_url".split(),
    "date": "date created published timestamp created_at published_at publishedat updated_at time datetime pub_date pubdate modified posted_at".split(),
    "content": "content body text description summary excerpt abstract html full_text post_content body_html content_html subtitle".split(),
    "author": "author creator writer byline author_name user".split(),
    "image": "image thumbnail thumb img photo cover image_url thumbnail_url featured_image og_image cover_image".split(),
}
ROLE_POINTS = {"title": 0.25, "url": 0.20, "date": 0.15, "content": 0.10, "author": 0.05, "image": 0.03}
#: item fields and the roles that fill them
FIELD_OF_ROLE = {"title": "title", "url": "link", "content": "content", "date": "timestamp", "image": "thumbnail", "author": "author"}
MIN_SCORE = 0.15

# Paging parameters, after lower-casing and dropping "-" and "_".
PAGE_KEYS = ["pagenumber", "page", "pageindex", "p"]
OFFSET_KEYS = ["offset", "from", "skip", "start"]
CURSOR_KEYS = ["cursor", "after", "nextcursor", "pagecursor", "pagetoken"]
PER_PAGE_KEYS = ["perpage", "pagesize", "limit", "size"]
HAS_MORE_KEYS = ["hasmore", "hasnext", "more"]
NEXT_CURSOR_KEYS = ["nextcursor", "endcursor", "next"]
TOTAL_PAGES_KEYS = ["totalpages", "pagecount", "pages"]
REPLAY_HEADERS = ["content-type", "accept", "accept-language"]

FEED_PATHS = "/feed /feed/ /rss /rss/ /atom.xml /feed.xml /index.xml /rss.xml /feed/rss /feed/atom /.rss /blog/feed /blog/rss /wp-json/wp/v2/posts".split()
FEED_TYPES = "application/rss+xml application/atom+xml application/feed+json application/json text/xml application/xml".split()

FRAMEWORKS = {
    "next.js": "__next_data__", "nuxt.js": "__nuxt__", "gatsby": "___gatsby", "react": "data-reactroot",
    "angular": "ng-version", "vue.js": "data-v-", "svelte": "__svelte", "wordpress": "wp-content",
}
ANTI_BOT = ["cf-browser-verification", "challenge-platform", "turnstile", "just a moment", "checking your browser"]

# Class, id and role patterns of nodes.
POSITIVE = "article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story|card|tile|teaser|listing|result|item|media-block|media-list|media-object|media-item|news-item|feed-item|grid-item"
NEGATIVE = "-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget"
UNLIKELY = "-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote"
MAYBE = "and|article|body|column|content|main|mathjax|shadow"
TAXONOMY = r"(^|[-_\s])(term|terms|tag|tags|category|categories|cat|cats|filter|filters|facet|facets|taxonomy|taxonomies|chip|chips|pill|pills|label|labels|expand-item|expand-items)([-_\s]|$)"
UNLIKELY_ROLES = "menu menubar complementary navigation alert alertdialog dialog".split()
TAG_BASELINE = {"article": 10, "section": 5, "div": 5, "li": 2, "tr": 2, "nav": -15, "footer": -15, "aside": -15, "header": -10, "form": -10}
ITEM_TAGS = ["article", "li", "div", "section", "tr"]
MIN_REPEATS = 3
LOW_VALUE_ANCESTORS = ["nav", "footer", "aside", "header"]

# Utility classes (layout helpers that name no component).
UTILITY_VARIANT = r"^((sm|md|lg|xl|2xl|3xl|hover|focus|first|last|active|disabled|dark|group-hover):)+"
UTILITY_EXACT = (
    "flex-row flex-col flex-wrap flex-nowrap flex-row-reverse flex-col-reverse flex-auto flex-1 flex-none flex-initial flex-grow flex-shrink "
    "items-start items-end items-center items-baseline items-stretch justify-start justify-end justify-center justify-between justify-around justify-evenly "
    "self-auto self-start self-end self-center self-stretch grid-flow-row grid-flow-col grid-flow-row-dense grid-flow-col-dense "
    "flex grid hidden block inline relative absolute fixed sticky static"
).split()
UTILITY_COMPOUND = r"^(grid-cols|grid-rows|col-span|row-span|col-start|col-end|row-start|row-end)-\d+$"
UTILITY_PREFIXES = (
    "w- h- m- p- mx- my- px- py- mt- mb- ml- mr- pt- pb- pl- pr- text- bg- border- grid-cols- grid-rows- grid-flow- items- justify- gap- space- rounded- shadow- opacity- "
    "z- top- left- right- bottom- max- min- overflow- leading- tracking- font- col-span- col-start- row-span- order- grow- shrink- aspect- object- inline-"
).split()

# Dates in text.
MONTHS = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)"
DATES = [
    r"\b\d{4}-\d{2}-\d{2}(?:[t ]\d{2}:\d{2}(?::\d{2})?)?\b",
    rf"\b{MONTHS}[a-z]*\.?\s+\d{{1,2}},?\s+\d{{4}}\b",
    rf"\b\d{{1,2}}\s+{MONTHS}[a-z]*\.?\s+\d{{4}}\b",
    r"\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b",
    r"\b\d+\s+(?:second|minute|hour|day|week|month|year)s?\s+ago\b",
    r"\b(?:yesterday|today)\b",
]

# URLs of APIs in scripts and captures.
API_PATHS = r"/api/|/v[1-9]/|/graphql|/wp-json/|/_next/data/|/rest/|/query"
API_WORDS = r"(^|[/.])(posts|articles|events|entries|items|listings|news|feed|blog|stories|updates)([/.?]|$)"
API_EXCLUDED = r"analytics|tracking|pixel|beacon|/log(s)?(/|$)|google-analytics|facebook\.com|doubleclick|/ads/|sentry\.io|hotjar\.com|cloudflare|/auth/|/login|/logout|/oauth|/token|\.(css|js|png|jpg|jpeg|gif|svg|woff2?|ttf|ico)(\?|$)"
JS_ABSOLUTE = "[\"'`](https?://[^\"'`\\s]{8,300})[\"'`]"
JS_RELATIVE = "[\"'`](/(?:api|v[1-9]|wp-json|rest|graphql)[^\"'`\\s]{2,200})[\"'`]"
CAPTURE_EXCLUDED = (
    r"analytics|tracking|pixel|beacon|/logs?(?:/|$)|google-analytics|facebook\.com|doubleclick|/ads/|sentry\.io|hotjar\.com|cloudflare\.com/cdn-cgi"
    r"|googleapis\.com/(?!.*(?:sheets|drive|blogger))|fonts\.|recaptcha|turnstile|hcaptcha|\.(?:css|js|png|jpg|jpeg|gif|svg|woff2?|ttf|ico|webp)(?:\?|$)|/auth/|/login|/logout|/oauth|/token"
)
BINARY_RESOURCE = r"\.(png|jpg|jpeg|gif|svg|webp|woff2?|ttf|eot|ico|mp4|mp3|pdf|zip)(\?|$)"
SCRIPT_NAMES = "__NEXT_DATA__ __NUXT__ __INITIAL_STATE__ __PRELOADED_STATE__ __data__ __remixContext __APOLLO_STATE__ __INITIAL_PROPS__ __APP_STATE__ __REDUX_STATE__ __PAGE_DATA__".split()

# Pruning: elements that go with their subtree, elements whose children take their place, and what is cut when empty.
NOISE_TAGS = "script style button dialog embed form input map menu noscript object output select svg textarea applet iframe frame frameset noframes".split()
STRUCTURAL_NOISE = ["aside", "footer"]
WRAPPER_TAGS = "area base basefont bdi bdo blink canvas col colgroup data datalist figcaption fieldset link meta optgroup option param progress rp rt rtc ruby slot source template track use wbr".split()
CUT_EMPTY = "article b blockquote dd div dt em h1 h2 h3 h4 h5 h6 i li main p pre q section span strong".split()
PRUNABLE = ["div", "item", "list", "p", "section", "span"]
#: Terms that mark an element as chrome, by attribute; "first" is the first of id and class in document order.
CHROME = {
    "class": {"in": "ooter elated share- sociable embed subnav tag-list menu avigation navbar navbox attachment outbrain taboola criteo consent modal-content permission mol-factbox yin zlylin xg1 overlay paid-content paidcontent obfuscated blurred".split() + [" ad "], "start": ["nav", "post-nav", "ZendeskForm"]},
    "id": {"in": "ooter related hare menu bmdh premium".split() + ["nav", "Nav"], "start": ["jp-", "dpsp-content"]},
    "first": {"in": "viral social syndication newsletter cookie tags sidebar banner breadcrumb bread-crumb button message-container".split(), "start": ["shar"]},
    "role": {"in": ["nav", "Nav"], "start": []},
}
HIDDEN = {"class": {"in": ["comments-title", "nocomments", "-reply-", "message", "akismet", "suggest-links", "-hide-", "hide-print", " hidden", " hide", "noprint", "notloaded"], "start": ["hide-"]}, "id": {"in": ["reader-comments", "akismet", "hidden"], "start": []}, "first": {"in": [], "start": ["reply-"]}, "style": {"in": ["display:none", "display: none", "hidden"], "start": []}}
PROSE_ONLY = {"class": {"in": "bar meta yline rating widget timestamp user-info user-profile -ad- -icon article-infos nfoline options expand next- -stories most-popular slide viewport".split(), "start": []}, "first": {"in": ["author"], "start": []}}
COMMENTS = {"id": {"in": [], "start": ["comment", "Comment", "comol", "disqus_thread", "dsq-comments"]}, "class": {"in": ["article-comments", "post-comments"], "start": ["comment", "Comment"]}}

SMART_PUNCTUATION = {
    "'": "‘’‚‛′", '"': "“”„‟″", "-": "‐‑‒–—−",
}
CADENCE_SECONDS = {"15m": 900, "1h": 3_600, "6h": 21_600, "1d": 86_400, "1w": 604_800}
STRATEGIES = "rss json_api json_dot_notation xpath xml_xpath embedded_json rss_bridge graphql".split()
