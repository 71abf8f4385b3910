"""URL verdicts: domain and path rules, and a logistic regression on hashed character n-grams of host and path (operator 7).

The regression is trained on the small labelled table below; scores and rules are
applied row by row, without a shuffle. Rules travel as one small list.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm.common import ship_package

#: Rules of the contract (fixed values): (verdict, host and path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: Labelled URLs: 1 is unwanted. Host names are general vocabulary, none is a host of the given tables; prefixes, domains and paths go round alike in both labels.
LABELLED = [(u, 1) for u in """
online-casino.example/ win-roulette.example/en/ www.giftcard-claim.example/page/3 m.easy-cash.example/article/17 blog.sex-chat.example/de/index
discount-viagra.test.example/fr/a-propos lucky-slots.test.example/es/inicio www.adult-video.test.example/view?id=5 m.mailer-link.test.example/2019/05/
blog.jackpot-win.test.example/about forex-profit.shop.example/contact cheap-viagra.shop.example/items/42.html www.serial-torrent.shop.example/
m.sport-betting.shop.example/en/ blog.buy-meds.shop.example/page/3 lottery-bonus.site.example/article/17 phishing-secure.site.example/de/index
www.porn-cams.site.example/fr/a-propos m.nude-video.site.example/es/inicio blog.dating-sex.site.example/view?id=5 outlet-handbags.example/2019/05/
blog-spam.example/about www.live-bets.example/contact m.torrent-pirate.example/items/42.html blog.serial-crack.example/
affiliate-track.test.example/en/ backlink-blog.test.example/page/3 www.ads-pixel.test.example/article/17 m.video-xxx.test.example/de/index
blog.seo-farm.test.example/fr/a-propos replica-cheap.shop.example/es/inicio farm-backlink.shop.example/view?id=5
www.pharmacy-buy.shop.example/2019/05/ m.odds-sport.shop.example/about blog.network-affiliate.shop.example/contact
free-warez.site.example/items/42.html free-giftcard.site.example/ www.bonus-poker.site.example/en/ m.farm-link.site.example/page/3
blog.buy-cialis.site.example/article/17 torrent-free.example/de/index verify-update.example/fr/a-propos www.tips-bookmaker.example/es/inicio
m.pills-buy.example/view?id=5 blog.backlink-network.example/2019/05/ lucky-roulette.test.example/about viagra-buy.test.example/contact
www.prize-winner.test.example/items/42.html m.apply-loan.test.example/ odds-big.shop.example/page/3 viagra-online.shop.example/article/17
www.network-seo.shop.example/de/index m.roulette-online.shop.example/fr/a-propos blog.poster-backlink.shop.example/es/inicio
forex-scheme.site.example/view?id=5 doubler-forex.site.example/2019/05/ www.affiliate-manager.site.example/about m.winner-iphone.site.example/contact
blog.tube-porn.site.example/items/42.html popup-pixel.example/ poker-win.example/en/ www.network-ads.example/page/3 m.slots-bonus.example/article/17
blog.royal-slots.example/de/index discount-pills.test.example/fr/a-propos instant-giftcard.test.example/es/inicio
www.sport-bookmaker.test.example/view?id=5 m.slots-online.test.example/2019/05/ blog.track-banner.test.example/about chat-adult.shop.example/contact
cams-sex.shop.example/items/42.html www.rolex-outlet.shop.example/ m.verify-bank.shop.example/en/ blog.herbal-cialis.shop.example/page/3
xxx-chat.site.example/article/17 cialis-cheap.site.example/de/index www.payday-apply.site.example/fr/a-propos m.cheap-pharmacy.site.example/es/inicio
blog.discount-pharmacy.site.example/view?id=5 handbags-sale.example/2019/05/ crypto-doubler.example/about www.instant-prize.example/contact
m.tube-nude.example/items/42.html blog.viagra-herbal.example/ server-affiliate.test.example/en/ update-phishing.test.example/page/3
www.download-crack.test.example/article/17 m.fake-handbags.test.example/de/index blog.pixel-banner.test.example/fr/a-propos
big-bookmaker.shop.example/es/inicio free-odds.shop.example/view?id=5 www.online-jackpot.shop.example/2019/05/ m.bets-big.shop.example/about
blog.server-ads.shop.example/contact network-popup.site.example/items/42.html quick-payday.site.example/ www.login-account.site.example/en/
m.betting-live.site.example/page/3 blog.pharmacy-online.site.example/article/17 bookmaker-live.example/de/index tube-adult.example/fr/a-propos
www.free-prize.example/es/inicio m.update-login.example/view?id=5 blog.iphone-instant.example/2019/05/ track-click.test.example/about
affiliate-pixel.test.example/contact www.quick-credit.test.example/items/42.html m.iphone-free.test.example/ blog.pills-herbal.test.example/en/
bookmaker-free.shop.example/page/3 replica-sale.shop.example/article/17 www.instant-payday.shop.example/de/index m.crack-free.shop.example/fr/a-propos
blog.online-cialis.shop.example/es/inicio betting-free.site.example/view?id=5 live-odds.site.example/2019/05/ www.secure-verify.site.example/about
m.bitcoin-rich.site.example/contact blog.cialis-discount.site.example/items/42.html chat-porn.example/ crack-pirate.example/en/
www.instant-credit.example/page/3 m.sex-tube.example/article/17 blog.roulette-bonus.example/de/index loan-quick.test.example/fr/a-propos
bank-phishing.test.example/es/inicio www.download-torrent.test.example/view?id=5 m.meds-cheap.test.example/2019/05/ blog.porn-video.test.example/about
banner-server.shop.example/contact keygen-download.shop.example/items/42.html www.credit-apply.shop.example/ m.adult-cams.shop.example/en/
blog.pills-online.shop.example/page/3 blog-seo.site.example/article/17 prize-claim.site.example/de/index www.profit-bitcoin.site.example/fr/a-propos
m.cams-xxx.site.example/es/inicio blog.pharmacy-herbal.site.example/view?id=5 warez-serial.example/2019/05/ poker-royal.example/about
www.pirate-warez.example/contact m.chat-nude.example/items/42.html blog.outlet-replica.example/ jackpot-royal.test.example/en/
bets-sport.test.example/page/3 www.mailer-backlink.test.example/article/17 m.sale-rolex.test.example/de/index
blog.bonus-casino.test.example/fr/a-propos adult-dating.shop.example/es/inicio login-secure.shop.example/view?id=5
www.network-spam.shop.example/2019/05/ m.porn-dating.shop.example/about blog.bonus-jackpot.shop.example/contact
cash-instant.site.example/items/42.html casino-lucky.site.example/ www.odds-tips.site.example/en/ m.easy-loan.site.example/page/3
blog.click-network.site.example/article/17 xxx-tube.example/de/index online-poker.example/fr/a-propos www.spam-poster.example/es/inicio
m.scheme-crypto.example/view?id=5 blog.royal-lottery.example/2019/05/ giftcard-winner.test.example/about profit-crypto.test.example/contact
www.credit-easy.test.example/items/42.html m.loan-instant.test.example/ blog.manager-banner.test.example/en/ win-slots.shop.example/article/17
www.video-sex.shop.example/de/index m.manager-click.shop.example/fr/a-propos blog.poker-lucky.shop.example/es/inicio
jackpot-lucky.site.example/view?id=5 big-betting.site.example/2019/05/ www.casino-royal.site.example/about m.rich-forex.site.example/contact
blog.pirate-keygen.site.example/items/42.html cheap-rolex.example/ banner-network.example/en/ www.free-keygen.example/page/3
m.herbal-meds.example/article/17 blog.royal-roulette.example/de/index lucky-lottery.test.example/fr/a-propos scheme-bitcoin.test.example/es/inicio
www.pixel-click.test.example/view?id=5 m.bitcoin-doubler.test.example/2019/05/ blog.bets-tips.test.example/about poster-link.shop.example/contact
www.bank-login.shop.example/ m.popup-track.shop.example/en/ blog.online-meds.shop.example/page/3 fake-replica.site.example/article/17
tips-betting.site.example/de/index www.phishing-account.site.example/fr/a-propos m.warez-download.site.example/es/inicio
blog.server-popup.site.example/view?id=5 lottery-online.example/2019/05/ ads-manager.example/about www.dating-xxx.example/contact
m.nude-cams.example/items/42.html blog.link-blog.example/ nude-dating.test.example/en/ crypto-rich.test.example/page/3
www.link-network.test.example/article/17 m.payday-easy.test.example/de/index blog.popup-manager.test.example/fr/a-propos
cash-quick.shop.example/es/inicio claim-iphone.shop.example/view?id=5
""".split()] + [(u, 0) for u in """
seaside-diamond.example/ reading-fisherman.example/en/ www.ocean-hospital.example/page/3 m.apple-history.example/article/17
blog.mathematics-village.example/de/index festival.test.example/fr/a-propos forest-winery.test.example/es/inicio www.clinic.test.example/view?id=5
m.painter.test.example/2019/05/ blog.horizon.test.example/about shepherd-running.shop.example/contact prairie.shop.example/items/42.html
www.law.shop.example/ m.fire-brigade.shop.example/en/ blog.cedar-university.shop.example/page/3 rainbow.site.example/article/17
desert.site.example/de/index www.alphabet.site.example/fr/a-propos m.bookshop.site.example/es/inicio blog.coastline-bank.site.example/view?id=5
betterhomes.example/2019/05/ university-harbour.example/about www.meadow-cedar.example/contact m.hammer-painting.example/items/42.html
blog.century-academy.example/ climbing-gardening.test.example/en/ pottery.test.example/page/3 www.encyclopedia-copper.test.example/article/17
m.winter.test.example/de/index blog.mineral.test.example/fr/a-propos free-software.shop.example/es/inicio basket.shop.example/view?id=5
www.summer.shop.example/2019/05/ m.beacon.shop.example/about blog.eastern.shop.example/contact water-mathematics.site.example/items/42.html
history.site.example/ www.translation-science.site.example/en/ m.leather.site.example/page/3 blog.information.site.example/article/17
lantern.example/de/index teacher-painter.example/fr/a-propos www.acorn-desert.example/es/inicio m.travel.example/view?id=5
blog.running.example/2019/05/ silver.test.example/about window-government.test.example/contact www.butterfly-winter.test.example/items/42.html
m.mechanics.test.example/ blog.feather-biology.test.example/en/ education-clinic.shop.example/page/3 woodland-dolphin.shop.example/article/17
www.walnut.shop.example/de/index m.magazine.shop.example/fr/a-propos blog.library-recipes.shop.example/es/inicio
workshop-southern.site.example/view?id=5 python-docs.site.example/2019/05/ www.fountain-bridge.site.example/about m.fisherman.site.example/contact
blog.station-autumn.site.example/items/42.html garden.example/ evening-sandstone.example/en/ www.adoption-adventure.example/page/3
m.post-office.example/article/17 blog.hospital.example/de/index hiking.test.example/fr/a-propos textile.test.example/es/inicio
www.autumn-railway.test.example/view?id=5 m.photography.test.example/2019/05/ blog.bamboo-journey.test.example/about
bridge-quarry.shop.example/contact carpenter-workshop.shop.example/items/42.html www.gallery.shop.example/ m.freelance.shop.example/en/
blog.poetry-photography.shop.example/page/3 weather.site.example/article/17 cabinet.site.example/de/index www.journal-bamboo.site.example/fr/a-propos
m.highland.site.example/es/inicio blog.paper.site.example/view?id=5 village.example/2019/05/ geology-yellow.example/about www.western.example/contact
m.whisper.example/items/42.html blog.compass.example/ dentist-freedom.test.example/en/ diamond.test.example/page/3
www.painting-engine.test.example/article/17 m.country.test.example/de/index blog.radio-sculpture.test.example/fr/a-propos
household.shop.example/es/inicio engine-orchestra.shop.example/view?id=5 www.sparrow.shop.example/2019/05/ m.national-silver.shop.example/about
blog.loading.shop.example/contact medicine.site.example/items/42.html quarry-mineral.site.example/ www.heritage-island.site.example/en/
m.harbour.site.example/page/3 blog.parliament.site.example/article/17 pharmacy-college.example/de/index astronomy-apple.example/fr/a-propos
www.pencil-leather.example/es/inicio m.museum.example/view?id=5 blog.thunder.example/2019/05/ court.test.example/about
choir-paper.test.example/contact www.insurance.test.example/items/42.html m.tradition.test.example/ blog.adriatic.test.example/en/
chess.shop.example/page/3 gardening-court.shop.example/article/17 www.painting.shop.example/de/index m.science.shop.example/fr/a-propos
blog.anchor.shop.example/es/inicio chemistry.site.example/view?id=5 sunrise-architecture.site.example/2019/05/ www.planet.site.example/about
m.cottage.site.example/contact blog.bridge.site.example/items/42.html southern.example/ flower-theatre.example/en/ www.river-magazine.example/page/3
m.ocean.example/article/17 blog.southern-ocean.example/de/index dentist.test.example/fr/a-propos architecture-basket.test.example/es/inicio
www.encyclopedia.test.example/view?id=5 m.pepper.test.example/2019/05/ blog.island-insurance.test.example/about dolphin.shop.example/contact
architecture.shop.example/items/42.html www.nursing-tennis.shop.example/ m.pioneer.shop.example/en/ blog.railway-medicine.shop.example/page/3
evening.site.example/article/17 city-news.site.example/de/index www.government-education.site.example/fr/a-propos
m.violin-council.site.example/es/inicio blog.sunrise.site.example/view?id=5 weaver.example/2019/05/ cottage-cycling.example/about
www.copper-pencil.example/contact m.biology.example/items/42.html blog.swimming.example/ nursing.test.example/en/ orchestra.test.example/page/3
www.pencil.test.example/article/17 m.tennis-lighthouse.test.example/de/index blog.winery-nature.test.example/fr/a-propos
lighthouse.shop.example/es/inicio nature-violin.shop.example/view?id=5 www.window.shop.example/2019/05/ m.feather.shop.example/about
blog.mathematics.shop.example/contact timber-police.site.example/items/42.html theatre-station.site.example/ www.council.site.example/en/
m.sandstone-water.site.example/page/3 blog.autumn.site.example/article/17 carpenter.example/de/index northern.example/fr/a-propos
www.national.example/es/inicio m.council-horizon.example/view?id=5 blog.timber.example/2019/05/ health-timber.test.example/about
winery.test.example/contact www.morning-radio.test.example/items/42.html m.tennis.test.example/ blog.pioneer-coastline.test.example/en/
granite-sailor.shop.example/page/3 novels.shop.example/article/17 www.orchard.shop.example/de/index m.school-shepherd.shop.example/fr/a-propos
blog.academy.shop.example/es/inicio cedar.site.example/view?id=5 orchard-alphabet.site.example/2019/05/ www.farmers-market.site.example/about
m.lighthouse-granite.site.example/contact blog.workshop.site.example/items/42.html cycling-school.example/ daylight.example/en/
www.mountain.example/page/3 m.yellow-eastern.example/article/17 blog.adventure.example/de/index station.test.example/fr/a-propos
university.test.example/es/inicio www.quarry.test.example/view?id=5 m.geology.test.example/2019/05/ blog.library.test.example/about
woodland.shop.example/contact bank-highland.shop.example/items/42.html www.recipes.shop.example/ m.dolphin-parliament.shop.example/en/
blog.sandstone.shop.example/page/3 physics-sunrise.site.example/article/17 flower.site.example/de/index www.forest.site.example/fr/a-propos
m.orchestra-tradition.site.example/es/inicio blog.island.site.example/view?id=5 apple.example/2019/05/ government.example/about
www.astronomy.example/contact m.football.example/items/42.html blog.choir.example/ teacher.test.example/en/ nature.test.example/page/3
www.biology-factory.test.example/article/17 m.meadow.test.example/de/index blog.translation.test.example/fr/a-propos
weaver-freelance.shop.example/es/inicio shepherd.shop.example/view?id=5 www.morning.shop.example/2019/05/ m.mountain-adoption.shop.example/about
blog.madrid.shop.example/contact planet-bookshop.site.example/items/42.html copper.site.example/ www.sculpture-travel.site.example/en/
m.seaside.site.example/page/3 blog.acorn.site.example/article/17 glacier.example/de/index theatre.example/fr/a-propos www.fountain.example/es/inicio
m.reading.example/view?id=5 blog.journal.example/2019/05/ sailor-morning.test.example/about sailor.test.example/contact
www.violin.test.example/items/42.html m.railway.test.example/ blog.butterfly.test.example/en/ climbing.shop.example/page/3
download-docs.shop.example/article/17 www.journey.shop.example/de/index m.chemistry-household.shop.example/fr/a-propos
blog.adventure-madrid.shop.example/es/inicio pepper-carpenter.site.example/view?id=5 swimming-fountain.site.example/2019/05/
www.valley.site.example/about m.poetry.site.example/contact blog.cycling.site.example/items/42.html music.example/ health.example/en/
www.recipes-gallery.example/page/3 m.gardening.example/article/17 blog.yellow.example/de/index glacier-valley.test.example/fr/a-propos
coastline.test.example/es/inicio www.heritage.test.example/view?id=5 m.madrid-teacher.test.example/2019/05/ blog.physics.test.example/about
bank.shop.example/contact education.shop.example/items/42.html www.granite.shop.example/ m.century.shop.example/en/
blog.academy-poetry.shop.example/page/3 journey-woodland.site.example/article/17 hammer.site.example/de/index www.sculpture.site.example/fr/a-propos
m.radio.site.example/es/inicio blog.northern-anchor.site.example/view?id=5 police.example/2019/05/ freedom-cottage.example/about
www.engine.example/contact m.cathedral.example/items/42.html blog.music-glacier.example/ kitchen.test.example/en/ daylight-garden.test.example/page/3
www.candle-pottery.test.example/article/17 m.anchor-window.test.example/de/index blog.notebook-kitchen.test.example/fr/a-propos
police-choir.shop.example/es/inicio football-weaver.shop.example/view?id=5 www.factory-loading.shop.example/2019/05/
m.kitchen-rainbow.shop.example/about blog.cathedral-compass.shop.example/contact science-meadow.site.example/items/42.html
novels-country.site.example/ www.valley-pepper.site.example/en/
""".split()]

BITS, GRAMS = 14, (3, 4, 5)
STEPS, RATE, RIDGE = 400, 0.5, 1e-3


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` up to / ? # or the end, A-Z lower-cased; path from there up to ? # or the end."""
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    end = min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))
    rest = rest[:end]
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return host.translate(_LOWER), path


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(host: str, path: str) -> np.ndarray:
    """Distinct hashed character n-grams; those of host and path differ."""
    import zlib
    found = {zlib.crc32(f"{kind}{text[i:i + n]}".encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
             for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in GRAMS for i in range(len(text) - n + 1)}
    return np.fromiter(found, np.int64, len(found))


def train(labelled: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression; features of a URL share unit length."""
    x = [grams(*split_url(u if "://" in u else f"http://{u}")) for u, _ in labelled]
    y = np.array([label for _, label in labelled], float)
    flat, row = np.concatenate(x), np.repeat(np.arange(len(x)), [v.size for v in x])
    scale = (1 / np.sqrt([max(v.size, 1) for v in x]))[row]
    w, bias = np.zeros(1 << BITS), 0.0
    squares, square = np.full(w.size, 1e-8), 1e-8
    for _ in range(STEPS):
        error = (1 / (1 + np.exp(-(np.bincount(row, scale * w[flat], y.size) + bias))) - y) / y.size
        grad = np.bincount(flat, scale * error[row], w.size) + RIDGE * w
        squares += grad * grad
        w -= RATE * grad / np.sqrt(squares)
        square += error.sum() ** 2
        bias -= RATE * error.sum() / np.sqrt(square)
    return w, bias


def probability(model: tuple[np.ndarray, float], host: str, path: str) -> float:
    """How likely the URL is unwanted; the bias alone for an empty URL."""
    x = grams(host, path)
    return float(1 / (1 + np.exp(-(model[0][x].sum() / max(1.0, np.sqrt(x.size)) + model[1]))))


def matching_rule(rules: list[tuple[str, str]], host: str, path: str) -> tuple[str, str] | None:
    """(verdict, rule) of the longest rule whose host is this one or a parent of it and whose path the URL's path starts with."""
    best = None
    for verdict, rule in rules:
        at = rule.index("/")
        if (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:]) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: list[tuple[str, int]] = LABELLED, block_at: float = 0.5) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, score.

    A rule decides; without one, the classifier blocks from ``block_at`` on. A null url or
    one without ``://`` has an empty host and path, fits no rule and is judged by the
    classifier's bias alone. Of equally long rules the first in the list decides.
    Repeated rows get equal verdicts; other columns are ignored.
    """
    ship_package(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast((train(labelled), rules))

    @F.pandas_udf("host string, path string, rule string, verdict string, score double")
    def judge(urls):
        import pandas as pd
        model, rules_ = shared.value
        out = []
        for url in urls:
            host, path = split_url(url)
            p, hit = probability(model, host, path), matching_rule(rules_, host, path)
            out.append((host, path, hit[1] if hit else None, hit[0] if hit else ("block" if p >= block_at else "allow"), p))
        return pd.DataFrame(out, columns=["host", "path", "rule", "verdict", "score"])

    return pages.select("page_id", judge("url").alias("x")).select("page_id", "x.*")
