"""A small table of labelled urls, invented for this package, that op3's model learns from. No url of the inputs is read.

Both labels have the same ends of hosts and the same paths, so that neither a domain nor a language of a path tells them apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names of hosts to block (betting, pills, advertisements, tracking, link farms) and to allow.
BLOCK = tuple("casino-royal mega-casino casino-slots online-casino lucky-win big-win win-prize instant-win sports-bets bets-today bet-bonus best-bets free-money free-gift free-prize free-coins cheap-meds cheap-watches cheap-tabs cheap-loans buy-pills diet-pills pills-store blue-pills spam-links spam-mail link-farm click-farm like-farm content-farm ads pop-ads ads-server banner-ads track tracker track-clicks click-track poker-room poker-cash jackpot slots-bonus viagra-shop cialis-shop payday-loans quick-cash xxx-cams hot-cams porn-tube adult-dates crypto-doubler replica-bags seo-backlinks fake-followers".split())
ALLOW = tuple("library city-library university open-university museum history-museum news local-news weather daily-weather garden garden-notes recipes kitchen-recipes science science-review school primary-school music music-archive travel travel-diary books old-books maps city-maps health public-health law law-journal sports-club chess-club film-archive photo-album code code-notes data open-data forum help docs wiki research theatre radio family-farm farm-museum tracks-and-trails advice tiger-park winter-sports betony-garden freedom-press nature-trail the-nation that-thing thereon".split())
# What stands before and after a name, and the paths; dealt alike to both labels.
STARTS, ENDS = ("", "www.", "m.", "blog."), (".example.com", ".example.org", ".example.net", ".com", ".org", ".net")
PATHS = ("/en/1201", "/de/4410.html", "/fr/877", "/es/65/", "/", "/index.html", "/en/9034", "/de/318", "/fr/2215.html", "/es/7702", "/about", "/a/b/c")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): each name with each path, and thereby with the same starts and ends; label 1.0 to block, 0.0 to allow."""
    frames = [(STARTS[j % len(STARTS)], ENDS[j % len(ENDS)] + path) for j, path in enumerate(PATHS)]
    rows = [(f"https://{start}{name}{rest}", label) for label, names in ((1.0, BLOCK), (0.0, ALLOW)) for name in names for start, rest in frames]
    return spark.createDataFrame(rows, "url string, label double")
