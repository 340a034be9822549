"""Lookups: sites, languages, names, redirects, caches, polls, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyflow.functions import urls
from storyflow.operators import keys
from storyflow.shared import cut, drop

#: Names of languages and their codes.
LANGUAGES = {
    "Afrikaans": "afr",
    "Albanian": "sq",
    "Arabic": "ar",
    "Bahasa Indonesia": "id",
    "Bahasa Malaysia": "zsm",
    "Basa Jawa": "jav",
    "Bosanski": "bos",
    "Brezhoneg": "bre",
    "Bulgarian": "bg",
    "Catalan": "ca",
    "Català": "ca",
    "Cebuano": "ceb",
    "Chinese": "zh",
    "Chinuk Wawa": "chn",
    "Croatian": "hr",
    "Cymraeg": "cy",
    "Czech": "cs",
    "Danish": "da",
    "Dansk": "da",
    "Deutsch": "de",
    "Devanagari": "hi",
    "Dutch": "nl",
    "Eald Englisċ": "ang",
    "English": "en",
    "Español": "es",
    "Esperanto": "eo",
    "Euskara": "eu",
    "Farsi": "fa",
    "Filipino": "fil",
    "Finnish": "fi",
    "Français": "fr",
    "French": "fr",
    "Furlan": "fur",
    "Gaeilge": "ga",
    "Galego": "gl",
    "German": "de",
    "Greek": "el",
    "Gàidhlig": "gd",
    "Hausa | هَرْشَن هَوْسَ": "ha",
    "Hebrew": "he",
    "Hindi": "hi",
    "Hrvatski": "hr",
    "Hungarian": "hu",
    "Indonesian": "id",
    "Interlingua": "ia",
    "Italian": "it",
    "Italiano": "it",
    "Japanese": "ja",
    "Khuzdul": "mis",
    "Kiswahili": "sw",
    "Korean": "ko",
    "Kurdî | کوردی": "ckb",
    "Langue des signes québécoise": "fcs",
    "Latin": "la",
    "Latviešu valoda": "lv",
    "Lietuvių": "lt",
    "Lietuvių kalba": "lt",
    "Lingua latina": "la",
    "Lëtzebuergesch": "lb",
    "Magyar": "hu",
    "Malti": "mt",
    "Mikisúkî": "mik",
    "Nederlands": "nl",
    "Norsk": "no",
    "Norwegian": "no",
    "Nāhuatl": "nah",
    "Plattdüütsch": "nds",
    "Polish": "pl",
    "Polski": "pl",
    "Portuguese": "pt",
    "Português": "pt",
    "Português brasileiro": "pt-BR",
    "Português europeu": "pt-PT",
    "Punjabi": "pa",
    "Quenya": "qya",
    "Romanian": "ro",
    "Română": "ro",
    "Russian": "ru",
    "Scots": "sco",
    "Serbian": "sr",
    "Shqip": "sq",
    "Sindarin": "sjn",
    "Slovenčina": "sk",
    "Slovenščina": "sl",
    "Spanish": "es",
    "Suomi": "fi",
    "Svenska": "sv",
    "Swedish": "sv",
    "Thai": "th",
    "Tiếng Việt": "vi",
    "Turkish": "tr",
    "Türkçe": "fr",
    "Vietnamese": "vi",
    "Volapük": "vo",
    "Wikang Filipino": "fil",
    "af Soomaali": "som",
    "asturianu": "ast",
    "eesti keel": "et",
    "isiZulu": "zu",
    "kreyòl ayisyen": "ht",
    "maayaʼ tʼàan": "yua",
    "qazaqşa | қазақша": "kk",
    "tlhIngan-Hol": "tlh",
    "toki pona": "tok",
    "Íslenska": "is",
    "Čeština": "cs",
    "ʻŌlelo Hawaiʻi": "haw",
    "Ελληνικά": "el",
    "τσακώνικα": "tsd",
    "ϯⲙⲉⲧⲣⲉⲙⲛ̀ⲭⲏⲙⲓ": "cop",
    "Азәрбајҹан дили | آذربایجان دیلی": "aze",
    "Башҡорт теле": "ba",
    "Български": "bg",
    "Български език": "bg",
    "Кыргызча": "ky",
    "Нохчийн мотт": "ce",
    "Русский": "ru",
    "Српски": "sr",
    "Українська": "uk",
    "беларуская": "be",
    "македонски": "mk",
    "српски": "sr",
    "українська": "uk",
    "հայերեն": "hy",
    "יידיש": "yi",
    "עִבְרִית": "he",
    "עברית": "he",
    "ئۇيغۇر تىلى": "ug",
    "العربية": "ar",
    "اُردُو": "ur",
    "بهاس ملايو ": "ms",
    "فارسی": "fa",
    "لسان عثمانى": "ota",
    "پښتو": "ps",
    "ܐܪܡܝܐ | ארמיא": "arc",
    "मराठी": "mr",
    "हिन्दी": "hi",
    "বাংলা": "bn",
    "ਪੰਜਾਬੀ": "pa",
    "தமிழ்": "ta",
    "తెలుగు": "te",
    "ಕನ್ನಡ": "kn",
    "മലയാളം": "ml",
    "සිංහල": "si",
    "ไทย": "th",
    "བོད་སྐད་": "bod",
    "မြန်မာဘာသာ": "mya",
    "ქართული": "ka",
    "ភាសាខ្មែរ": "km",
    "ᠮᠠᠨᠵᡠ ᡤᡳᠰᡠᠨ": "mnc",
    "ᠮᠣᠩᠭᠣᠯ ᠪᠢᠴᠢᠭ᠌ | Монгол Кирилл үсэг": "mon",
    "中文": "zh",
    "中文-吴语": "wuu",
    "中文-客家话": "hak",
    "中文-广东话 粵語": "yue",
    "中文-普通话 國語": "zh",
    "中文-闽南话 臺語": "nan",
    "日本語": "ja",
    "한국말": "ko",
    "한국어": "ko",
    "𐌲𐌿𐍄𐌹𐍃𐌺𐌰": "got",
    "𒅴𒂠": "sux",
    "𓂋𓏺𓈖 𓆎𓅓𓏏𓊖": "egy",
}

#: A table may be broadcast up to so many rows, and bytes as JSON; larger ones are left to the planner.
SMALL, SMALL_BYTES = 100_000, 32 << 20


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its rows and bytes, counted, are few."""
    rows = df.limit(SMALL + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("n"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return F.broadcast(df) if n <= SMALL and size <= SMALL_BYTES else df


def language_code(name: Column, default: str = "en") -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.element_at(known, name), F.lit(default))


def routed(pages: DataFrame, sites: DataFrame, url: str = "url") -> DataFrame:
    """The site of each url: domain as it is, without ``www.``, with it.

    ``sites`` has domain, fragment, site. Of several for a domain, the first
    whose fragment is in the url counts; a null fragment is in any.
    """
    asked = pages.select("page_id", F.col(url).alias("_url"), F.posexplode(F.array(urls.domain(F.col(url)), urls.base_domain(F.col(url)), F.concat(F.lit("www."), urls.domain(F.col(url))))).alias("_try", "domain"))
    found = asked.join(small(sites.select("domain", "fragment", "site", "ord")), "domain").where(F.col("fragment").isNull() | F.contains("_url", F.col("fragment")))
    best = keys.first_by(found.select("page_id", "_try", "ord", "site"), ["page_id"], F.col("_try"), F.col("ord")).select("page_id", "site")
    return pages.join(best, "page_id", "left")


def names_of(df: DataFrame, ids: str, names: DataFrame) -> DataFrame:
    """Rows with their ids exploded and named (id, name), in order; the least name of an id counts."""
    one = names.groupBy("id").agg(F.min("name").alias("name"))
    return df.select("*", F.posexplode(ids).alias("place", "id")).join(small(one), "id", "left")


def redirects(spark, start: DataFrame, moves: DataFrame) -> DataFrame:
    """Where each url ends after its redirects (url, location); null if it never does.

    Every round doubles the length of the known paths, until none is longer than
    before: log2 of the longest chain, and of all moves where there are cycles.
    Of several locations of a url the least counts; null locations are none. More
    than ``SMALL`` moves are joined by a shuffle, so none of the rounds sends them
    through the driver.
    """
    hops = moves.where("location is not null").groupBy(F.col("url").alias("_from")).agg(F.min("location").alias("_to"))
    hops, path = cut(hops, "redirects")
    most, on = hops.count(), True
    beside = lambda df: df.hint("merge") if most > SMALL else df
    for _ in range(max(1, most).bit_length() + 1):
        nxt = hops.select(F.col("_from").alias("_mid"), F.col("_to").alias("_end"))
        longer, newer = cut(hops.join(beside(nxt), hops["_to"] == nxt["_mid"], "left").select("_from", F.coalesce("_end", "_to").alias("_to"), F.col("_end").isNotNull().alias("_on")), "redirects")
        drop(spark, path)
        hops, path = longer.select("_from", "_to"), newer
        on = not longer.where("_on").isEmpty()
        if not on:
            break
    if on:  # only paths into cycles still move
        sources = hops.select(F.col("_from").alias("_mid"))
        hops = hops.join(beside(sources), hops["_to"] == sources["_mid"], "left").select("_from", F.when(F.col("_mid").isNull(), F.col("_to")).alias("_to"))
    known = hops.withColumn("_known", F.lit(True))
    return start.join(beside(known), start["url"] == known["_from"], "left").select(start["*"], F.when(F.col("_known"), F.col("_to")).otherwise(F.col("url")).alias("final_url"))


def latest_cached(cache: DataFrame, now: Column, hours: float | None) -> DataFrame:
    """The newest entry of each key that is not too old; a negative or no limit is none."""
    young = cache if hours is None or hours < 0 else cache.where(F.col("ts") > now - F.make_dt_interval(hours=F.lit(0), mins=F.lit(0), secs=F.lit(hours * 3600.0)))
    return keys.first_by(young, ["cache_key"], -F.unix_micros("ts"), F.col("entry_id"))


def blob_join(resources: DataFrame, blobs: DataFrame, key_hash: Column) -> DataFrame:
    """Cached bodies of a key's hash, the newest resource of each key."""
    found = resources.where(F.col("cache_key_hash") == key_hash).join(blobs, "res_id")
    return keys.first_by(found, ["cache_key"], -F.col("last_used").cast("double"), F.col("res_id"))


def votes(polls: DataFrame, choices: DataFrame) -> DataFrame:
    """Votes of each choice, all and verified; choices without votes count 0.

    ``polls``: poll, votes (array of choice numbers), verified. ``choices``: poll,
    choice. Numbers that are no choice are left out.
    """
    cast = polls.select("poll", "verified", F.explode("votes").alias("choice"))
    counted = cast.groupBy("poll", "choice").agg(F.count("*").alias("votes"), F.count_if("verified").alias("verified_votes"))
    joined = choices.join(counted, ["poll", "choice"], "left")
    return joined.select("poll", "choice", F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce("verified_votes", F.lit(0)).alias("verified_votes"))


def dereferenced(objects: DataFrame, ref: str) -> DataFrame:
    """Objects with the object that their reference names, as ``target``."""
    target = objects.select(F.col("key").alias("_key"), F.col("body").alias("target"))
    return objects.join(target, F.col(ref) == F.col("_key"), "left").drop("_key")


def stat(rows: Column, header: str) -> Column:
    """Value of the first (header, value) whose header has a text."""
    return F.try_element_at(F.transform(F.filter(rows, lambda r: F.contains(r["header"], F.lit(header))), lambda r: r["value"]), F.lit(1))
