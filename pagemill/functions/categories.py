"""Patterns of content categories."""

from __future__ import annotations

# Categories by priority; for each the patterns of URL, title and content, the types of JSON-LD and the
# keywords that speak for it. All are matched in lower case.
PRIORITY = ["recipe", "product", "research", "code", "opinion", "news"]
PATTERNS = {
    "recipe": {
        "url": [r"/recipe/", r"/recipes/", r"/cooking/", r"allrecipes\.com", r"foodnetwork\.com", r"seriouseats\.com", r"bonappetit\.com", r"tasty\.co", r"recipetineats\.com"],
        "title": [r"\brecipe\b", r"\bhow to (make|cook|bake|prepare)\b", r"\bhomemade\b.*\b(make|recipe)\b"],
        "content": [
            r"\b(?:ingredients|you'll need|what you need)\s*[:\n]", r"\b(?:instructions|directions|method|preparation|steps)\s*[:\n]", r"\b(?:prep|cook|total)\s*(?:time)?\s*[:\n]", r"\b(?:servings|yields|serves)\s*[:\n]",
            r"\d+\s*(?:cups?|tbsp|tsp|oz|grams?|ml|lb)",
        ],
        "types": ["Recipe"], "words": ["recipe"],
    },
    "product": {
        "url": [r"amazon\.[a-z.]+/.*/dp/", r"amazon\.[a-z.]+/.*/gp/product/", r"amzn\.", r"ebay\.[a-z.]+/itm/", r"etsy\.[a-z.]+/listing/", r"shopify\.", r"/products?/", r"/shop/", r"/buy/", r"store\.", r"product\.hunt"],
        "title": [r"\bbuy\s+(?:now|online)\b", r"\bshop\s+(?:now|online)\b", r"\bprice\b.*\breview\b", r"\bproduct\s+review\b", r"\bbest\s+\w+\s+(?:under|for|review)\b"],
        "content": [
            r"\b(?:price|our price|sale price)\s*[:\$]", r"\b(?:add to cart|buy now|shop now|add to bag)\b", r"\b(?:customer reviews|ratings|out of \d+ stars)\b", r"\b(?:shipping|delivery|in stock|out of stock)\b",
            r"\b(?:sku|model|item number)\s*[:\n]", r"\b(?:features|specifications|specs)\s*[:\n]", r"\$\d+(?:\.\d{2})?(?:\s*(?:usd|cad|eur))?",
        ],
        "types": ["Product", "Offer", "AggregateOffer"], "words": ["product", "store", "shop"],
    },
    "research": {
        "url": [
            r"arxiv\.org", r"scholar\.google\.", r"dl\.acm\.org", r"ieeexplore\.ieee\.org", r"springer\.[a-z.]+/(chapter|article)", r"nature\.com/articles/", r"science\.org/doi/", r"sciencedirect\.com/science/article/",
            r"researchgate\.net/publication/", r"semanticscholar\.org/", r"doi\.org/", r"/doi/", r"/paper/", r"/publication/", r"academia\.edu",
        ],
        "title": [r"\babstract\b", r"\bwhite\s*paper\b", r"\bpreprint\b", r"\barxiv\b", r"\bresearch\s+(?:paper|article|study)\b", r"\bpeer-reviewed\b"],
        "content": [
            r"\babstract\s*[:\n]", r"\b(?:keywords|key\s*words)\s*[:\n]", r"\b(?:bibliography|references|cited|citations)\b", r"\b(?:doi|arxiv|isbn)\s*[:\n]", r"\b(?:university|institute|laboratory|lab)\b.*\b(?:department|faculty)\b",
            r"\b(?:published|accepted|submitted)\s+\d{4}", r"\b(?:volume|issue|pages?)\s*[:\n]",
        ],
        "types": ["ScholarlyArticle", "Article", "PublicationIssue", "Thesis"], "words": ["scholarly", "academic", "research", "citation"],
    },
    "code": {
        "url": [
            r"github\.com", r"gitlab\.com", r"bitbucket\.org", r"stackoverflow\.com", r"stackexchange\.com", r"npmjs\.com", r"pypi\.org", r"crates\.io", r"docs\.\w+\.(io|com|dev|org)", r"developer\.\w+\.(io|com|dev|org)",
            r"/(docs|documentation|api|reference)/", r"/(tutorial|tutorials|guide|guides)/",
        ],
        "title": [r"\b(?:how\s*to|getting\s*started|quick\s*start)\b", r"\b(?:tutorial|walkthrough|guide)\b", r"\b(?:api|sdk|library)\s+(?:reference|docs|documentation)\b", r"\b(?:install|setup|configuration)\s+(?:guide|instructions)\b", r"\b(?:hello\s*world|example|demo)\b"],
        "content": [
            r"(?s)```.*?```", r"``[^`]+``", r"\b(?:npm\s+(?:install|run)|yarn\s+(?:add|run)|pip\s+install)\b", r"\b(?:git\s+(?:clone|pull|push)|git\s+checkout)\b", r"""\b(?:import|require|from)\s+['"]\w+""",
            r"\b(?:function|class|def|fn|func|const|let|var)\s+\w+\s*[\(:=]", r"\b(?:cargo\s+(?:run|build)|go\s+(?:run|build|get))\b", r"\b(?:docker\s+(?:run|build|compose))\b", r"\b(?:kubectl|terraform)\s+\w+", r"(?s)<code>.*?</code>",
        ],
        "types": ["TechArticle", "APIReference"], "words": ["documentation", "api", "tutorial", "code", "developer"],
    },
    "news": {
        "url": [
            r"news\.[a-z.]+", r"cnn\.com", r"bbc\.[a-z.]+/news", r"nytimes\.com", r"washingtonpost\.com", r"theguardian\.com", r"reuters\.com", r"apnews\.com", r"bloomberg\.com", r"wsj\.com", r"usatoday\.com", r"nbcnews\.com",
            r"abcnews\.go\.com", r"cbc\.ca/news", r"/news/", r"/article/", r"/breaking/",
        ],
        "title": [r"\bbreaking(?:\s+news)?\b", r"\bexclusive\b", r"\breport\b.*\b(allegedly|sources?|according)\b", r"\b(?:confirmed|unconfirmed)\s+(?:reports?|sources?)\b", r"\b(?:according\s+to|sources?\s+say)\b"],
        "content": [
            r"\b(?:breaking|developing|just\s+in|update)\s*[:\n]", r"\b(?:reported|reports?|correspondent|journalist)\b", r"\b(?:according\s+to|sources?\s+(?:say|told|close\s+to))\b",
            r"\b(?:published|updated|modified)\s+(?:\d{1,2}/\d{1,2}|\w+\s+\d{1,2},?\s+\d{4})", r"\b(?:staff\s+writer|contributor|editor)\b",
        ],
        "types": ["NewsArticle", "Report", "LiveBlogPosting"], "words": ["news", "article", "breaking"],
    },
    "opinion": {
        "url": [r"/opinion/", r"/op-ed/", r"/editorial/", r"/column/", r"/commentary/", r"/blog/", r"/personal/", r"medium\.com/@", r"substack\.com", r"thehill\.com/opinion"],
        "title": [
            r"\bopinion\s*:|^opinion\b", r"\bop-ed\b", r"\bwhy\s+i\s+(?:think|believe|support|oppose)\b", r"\b(my|our)\s+(?:take|view|thoughts|perspective)\b", r"\b(?:the\s+)?case\s+(?:for|against)\b",
            r"\b(?:(?:in\s+)?my\s+opinion|imo|imho)\b", r"\bwhy\s+\w+\s+(?:matters?|is\s+(?:wrong|right|important))\b", r"\b(?:it's\s+time\s+to|we\s+need\s+to|we\s+should)\b",
        ],
        "content": [
            r"\b(?:in\s+my\s+(?:opinion|view)|imo|imho|personally)\b", r"\b(?:i\s+(?:think|believe|feel|argue|contend|maintain))\b", r"\b(?:i\s+am\s+(?:convinced|of\s+the\s+opinion|persuaded))\b",
            r"\b(?:from\s+my\s+(?:perspective|point\s+of\s+view|experience))\b", r"\b(?:this\s+is\s+(?:why|because)|let\s+me\s+explain)\b", r"\b(?:the\s+problem\s+(?:is|with)|the\s+solution\s+is)\b", r"\b(?:opinion|editorial|commentary|columnist)\b",
        ],
        "types": ["OpinionNewsArticle", "BlogPosting", "Commentary"], "words": ["opinion", "op-ed", "editorial", "commentary"],
    },
}
