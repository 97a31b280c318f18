"""URL filters: rules for hosts and paths, then logistic regression on character n-grams.

Everything is SQL expressions. The model is trained from a small labelled table
(at most TRAIN_ROWS rows), whose n-grams are hashed into BUCKETS; the descent runs
inside one expression over that table's one aggregated row, and only the BUCKETS
weights reach the driver. Scoring looks the weights up in a constant array, so a
table of urls is judged in one scan without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import UPPER, LOWER, table

BUCKETS = 4096
GRAMS = (3,)  # of 4-grams and of other numbers of buckets, held-out hosts of the labelled table speak less well
EPOCHS = 10
RATE = 0.1
DECAY = 1e-5
TRAIN_ROWS = 2_000

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

#: The labelled table: hosts of the kinds that a crawl meets, written for this purpose; none is of the sample tables.
GOOD_NAMES = (
    "springfield-library.org openair-museum.org riverside-school.edu northern-university.ac.uk city-council.gov.uk parish-church.org stadtbibliothek-bonn.de universitaet-sued.de "
    "mairie-de-lyon.fr lycee-victor.fr ayuntamiento-soria.es colegio-central.es regional-hospital.org childrens-clinic.org weather-service.gov national-park.gov "
    "daily-herald.com evening-standard-news.com morgenzeitung.de journal-du-soir.fr el-diario-regional.es science-review.org physics-letters.org journal-of-botany.org "
    "mathematics-teaching.net open-source-tools.org python-tutorials.io database-handbook.com linux-notes.net software-engineering-blog.com astronomy-club.org bird-watching.org.uk "
    "garden-planner.com grandmas-recipes.com slow-cooking.net bread-and-butter.co.uk mountain-hiking.org trail-maps.net cycling-routes.eu railway-timetable.com "
    "sailing-school.com football-history.net chess-association.org community-theatre.org string-quartet.org jazz-archive.net modern-painting.org photography-basics.com "
    "history-of-europe.org medieval-manuscripts.ac.uk genealogy-records.org poetry-society.org.uk short-stories.net book-reviews.com language-learning.com dictionary-online.org "
    "home-insulation.co.uk solar-energy-advice.org carpentry-workshop.com furniture-makers.com farmers-market.org beekeeping-guide.com animal-shelter.org veterinary-practice.com "
    "legal-advice-centre.org tax-office.gov consumer-rights.org employment-agency.co.uk public-transport.de tourism-board.fr island-ferries.com airport-information.com "
    "insurance-ombudsman.org.uk building-society.co.uk parents-forum.net school-meals.org nursing-college.edu medical-dictionary.org blood-donation.org red-kite-trust.org "
    "swimming-club.net village-hall.org.uk water-company.com museum-of-transport.org railway-museum.fr folk-music.net"
).split()
BAD_NAMES = (
    "royal-casino777.com vegas-slots-bonus.net online-poker-bonus.biz jackpot-casino-club.info sports-betting-tips.biz bet365-mirror.info roulette-wins.net lucky-lottery-winner.com "
    "discount-viagra-pills.com cialis-no-prescription.net canadian-pills-pharmacy.biz diet-pills-miracle.info buy-steroids-cheap.com cheap-meds-online.biz weight-loss-pills4u.com generic-pills-store.info "
    "free-porn-tube.com xxx-adult-videos.net live-sex-cams.info adult-dating-hot.biz escort-girls-xxx.com nude-adult-webcams.net hot-sex-chat.info adultfriend-hookup.com "
    "cheap-replica-watches.net fake-designer-bags.biz replica-rolex-cheap.info cheap-jerseys-wholesale.com payday-loans-instant.biz fast-cash-loans.info bad-credit-loans24.com free-credit-score-now.biz "
    "crypto-doubler-free.info free-bitcoin-generator.net earn-money-fast-free.biz work-from-home-rich.info you-win-free-iphone.com claim-your-free-prize.net free-gift-cards-win.biz winner-prize-claim.info "
    "ads-server-clicks.com pop-up-ads.net adclick-network.biz click-tracker-ads.info tracking-pixel-ads.com banner-ads-exchange.net track-redirect-click.biz adserver-track.info "
    "spam-links-directory.com link-farm-seo.net buy-backlinks-spam.biz seo-link-spammer.info spammy-guestbook.com bulk-email-spam.net warez-crack-serial.biz keygen-crack-free.info "
    "free-movie-torrents.net malware-download-free.biz virus-scan-alert-free.info account-verify-login.biz paypal-secure-verify.info bank-login-update.biz"
).split()
PREFIXES = ("", "www.", "m.", "blog.")
PATHS = ("/", "/index.html", "/en/12", "/de/340.html", "/fr/77/", "/es/519", "/en/2741", "/about/")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(host, path, bad): prefixes and paths go evenly over both classes, so that only names tell them apart."""
    rows = [(p + name, PATHS[(i + k) % len(PATHS)], bad) for names, bad in ((GOOD_NAMES, 0), (BAD_NAMES, 1)) for i, name in enumerate(names) for k, p in enumerate(PREFIXES)]
    values = ", ".join(f"('{h}', '{path}', {bad})" for h, path, bad in rows)
    return spark.sql(f"select * from values {values} as t(host, path, bad)")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.when(F.octet_length(found) == F.char_length(found), F.lower(found)).otherwise(F.translate(found, UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def buckets(host: Column, path: Column) -> Column:
    """The distinct buckets of the n-grams of host and path, which are marked apart."""
    text = F.concat(F.lit("^"), host, F.lit("$"), path, F.lit("$"))

    def hashed(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    return F.array_distinct(F.concat(*map(hashed, GRAMS)))


def fit_weights(labelled: DataFrame) -> list[float]:
    """BUCKETS weights and the intercept, by stochastic descent over the labelled rows in a fixed order.

    Rows with nulls are left out; without rows all weights are zero. More than
    TRAIN_ROWS rows are refused, as the table stands in one row here."""
    rows = labelled.where("host is not null and path is not null and bad is not null")
    if rows.limit(TRAIN_ROWS + 1).count() > TRAIN_ROWS:
        raise ValueError(f"more than {TRAIN_ROWS} labelled urls")
    rows = rows.select("host", "path", F.col("bad").cast("double").alias("bad"), buckets(F.col("host"), F.col("path")).alias("b"))
    # The column of ones at the end is the intercept's. Rows stand in the order of a hash, so that classes alternate.
    dense = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS)), lambda k: F.when((k == BUCKETS) | F.array_contains("b", k), 1.0).otherwise(0.0))
    one = rows.agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("host", "path").alias("o"), "bad", "b", dense.alias("x")))).alias("rows"))
    margin = f"u[{BUCKETS}] + aggregate(r.b, 0D, (s, k) -> s + u[k])"
    step = f"{RATE}D * (r.bad - 1 / (1 + exp(-({margin}))))"
    move = f"zip_with(v, r.x, (w, x) -> w * {1 - DECAY}D + g * x)"
    # The one-element array binds the step, so that it is computed once a row.
    epoch = f"aggregate(rows, t, (u, r) -> aggregate(array({step}), u, (v, g) -> {move}))"
    return one.select(F.expr(f"aggregate(sequence(1, {EPOCHS}), array_repeat(0D, {BUCKETS + 1}), (t, e) -> {epoch})").alias("w")).first()["w"]


def probability(host: Column, path: Column, weights: list[float]) -> Column:
    """The model's probability that a url is to be blocked."""
    table = F.expr("cast(split('" + ",".join(map(repr, weights[:-1])) + "', ',') as array<double>)")
    margin = F.aggregate(F.transform(buckets(host, path), lambda k: table[k]), F.lit(0.0), lambda s, x: s + x) + weights[-1]
    return 1 / (1 + F.exp(-margin))


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule whose host is the url's or above it, and with whose path the url's path starts."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
    return found if found is not None else F.lit(None).cast("string")


def filter_urls(pages: DataFrame, rules: dict[str, str] | None = None, weights: list[float] | None = None, limit: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's) of every row of pages (page_id, url).

    A null url, or one without `://`, has an empty host and path; no rule fits
    it, and the model judges it. A path that is empty starts with no rule's
    path. Repeated rows stay; an empty table gives no rows."""
    rules = RULES if rules is None else rules
    weights = fit_weights(labelled_urls(pages.sparkSession)) if weights is None else weights
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("score", probability(F.col("host"), F.col("path"), weights))
    verdicts = F.create_map(*(F.lit(x) for kv in rules.items() for x in kv)) if rules else None
    own = F.when(F.col("score") >= limit, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce(verdicts[F.col("rule")], own).alias("verdict") if rules else own.alias("verdict"), "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
