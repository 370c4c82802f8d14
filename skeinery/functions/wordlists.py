"""Word lists and tables that results depend on, stated plainly."""

CATEGORIES = ["video", "audio", "software", "game", "book", "adult", "archive", "other"]

# Substrings of the lower-cased name, by category, in order of precedence.
ADULT_WORDS = ["xxx", "porn", "p0rn", "hentai", "futanari", "uncensored", "brazzers", "onlyfans", "milf", "javhd", "1pondo", "caribbeancom", "nubiles", "eronite", "erotic", "bdsm", "creampie", "gangbang", " sex ", "sex.", "sex-", "18+"]
ADULT_CODES = ["miaa-", "miaa ", "ipz-", "sis001", "ssni", "abp-", "pred-", "mide-", "fsdss", "stars-", "ofje", "fes-", "juq-", "cawd", "ipx-", "ssis-"]
GAME_WORDS = ["fitgirl", "codex", "skidrow", "reloaded", "-plaza", "empress", "razor1911", "goldberg", "-tenoke", "dodi", "repack", "ps4", "ps3", "xbox360", "nsw", "-flt"]
SOFTWARE_WORDS = ["crack", "keygen", "activator", "x64", "x86", "win64", "office", "adobe", "autocad", "photoshop", "windows 1", "macos", "activated"]
BOOK_WORDS = ["ebook", "audiobook"]
AUDIO_WORDS = ["discography", "[flac]", "320kbps"]
VIDEO_WORDS = ["1080p", "720p", "2160p", "480p", "x264", "x265", "hevc", "bluray", "brrip", "webrip", "web-dl", "web.dl", "hdtv", "dvdrip", "xvid", "bdrip", "4k", "hdrip"]

# File extensions by category.
SOFTWARE_EXTENSIONS = ["exe", "msi", "dmg", "apk"]
BOOK_EXTENSIONS = ["pdf", "epub", "mobi", "azw3", "cbz", "cbr", "djvu"]
AUDIO_EXTENSIONS = ["mp3", "flac", "wav", "aac", "m4a", "ogg", "opus", "wma", "alac", "ape"]
VIDEO_EXTENSIONS = ["mkv", "mp4", "avi", "mov", "wmv", "m4v", "webm", "mpg", "mpeg", "m2ts", "ts", "vob", "flv", "ogv", "3gp", "rmvb"]
ARCHIVE_EXTENSIONS = ["zip", "rar", "7z", "tar", "gz"]

# Words added to the text of a document, by category.
CATEGORY_TEXT = {"video": "movie video", "audio": "music audio", "game": "game", "software": "software application", "book": "book ebook", "adult": "adult", "archive": "archive"}

# Category names accepted from callers.
CATEGORY_ALIASES = {"movies": "video", "tv": "video", "anime": "video", "music": "audio", "games": "game", "apps": "software", "books": "book"}

# Technical tags of release names.
NAME_TAGS = [
    "bluray", "blu-ray", "bdrip", "brrip", "web-dl", "webdl", "webrip", "web", "hdrip", "dvdrip", "dvd", "hdtv", "cam", "hdcam", "ts", "telesync", "remux",
    "x264", "x265", "h264", "h265", "hevc", "avc", "av1", "xvid", "divx", "aac", "ac3", "dts", "dd5", "ddp5", "atmos", "truehd", "flac", "mp3", "320kbps", "24bit",
    "hdr", "hdr10", "dv", "sdr", "10bit", "8bit", "imax", "extended", "remastered", "repack", "proper", "uncut", "unrated", "directors", "complete",
    "dual", "multi", "multisub", "sub", "subs", "dubbed", "dublaj", "turkish", "tr", "rus", "eng", "ita", "fre", "ger", "jpn", "kor", "chs", "cht",
    "internal", "limited", "retail", "iso", "mkv", "mp4", "avi", "epub", "pdf", "mobi", "zip", "rar", "7z", "exe", "apk", "gog", "rip", "portable", "cracked",
    "update", "dlc", "edition", "collection", "trilogy", "season", "series", "vol", "part",
]
RESOLUTIONS = {"480p": 480, "576p": 576, "720p": 720, "1080p": 1080, "1080i": 1080, "1440p": 1440, "2160p": 2160, "4k": 2160, "uhd": 2160}

# Query words without meaning of their own.
FILLERS = [
    "listeler misin", "listeleyebilir misin", "gösterir misin", "gösterebilir misin", "bulur musun", "bulabilir misin", "getirir misin", "arar mısın", "var mı", "var mi",
    "içinde", "icinde", "geçen", "gecen", "ile ilgili", "ilgili", "hakkında", "hakkinda", "konulu", "temalı", "temali", "tarzı", "tarzi", "gibi", "olan", "olanlar", "olanları",
    "bana", "lütfen", "lutfen", "bir", "birkaç", "tüm", "tum", "bütün", "butun", "en iyi", "show me", "list me", "list", "find me", "find", "search for", "search", "give me",
    "please", "can you", "could you", "i want", "i need", "looking for", "about", "containing", "with", "the", "some", "all", "best", "of", "for", "me", "a", "an", "any",
]

# Phrases replaced by what the names of the catalogue use.
PHRASE_ALIASES = [
    ("taht oyunları", "game of thrones"), ("taht oyunlari", "game of thrones"), ("yüzüklerin efendisi", "lord of the rings"), ("yuzuklerin efendisi", "lord of the rings"),
    ("yıldız savaşları", "star wars"), ("yildiz savaslari", "star wars"), ("açlık oyunları", "hunger games"), ("aclik oyunlari", "hunger games"),
    ("karayip korsanları", "pirates of the caribbean"), ("yürüyen ölüler", "the walking dead"), ("yuruyen oluler", "the walking dead"), ("uzay yolu", "star trek"),
    ("yıldız geçidi", "stargate"), ("kara şövalye", "the dark knight"), ("kara sovalye", "the dark knight"), ("örümcek adam", "spider-man"), ("orumcek adam", "spider-man"),
    ("demir adam", "iron man"), ("buz devri", "ice age"), ("narnia günlükleri", "chronicles of narnia"), ("esaretin bedeli", "the shawshank redemption"),
    ("canavarlar şirketi", "monsters inc"), ("ofis programı", "office"), ("ofis yazılımı", "office"), ("antivirüs", "antivirus security"),
    ("görüntü işleme", "photoshop image editing"), ("video düzenleme", "video editing premiere resolve"), ("bilim kurgu", "sci-fi science fiction"),
    ("çizgi film", "cartoon animation"), ("cizgi film", "cartoon animation"), ("süper kahraman", "superhero"), ("super kahraman", "superhero"), ("hayatta kalma", "survival"),
    ("araba yarışı", "racing"), ("araba yarisi", "racing"), ("ikinci dünya savaşı", "world war ii"),
]

# Concepts: phrase, replacement, examples for when the concept is the whole query.
CONCEPTS = [
    ("işletim sistemi", "operating system", "windows linux ubuntu debian mint fedora macos iso"),
    ("isletim sistemi", "operating system", "windows linux ubuntu debian mint fedora macos iso"),
    ("linux dağıtımı", "linux distribution", "ubuntu debian iso mint"),
    ("işletim sistemleri", "operating systems", "linux windows iso"),
]

# Words replaced by what the names of the catalogue use.
WORD_ALIASES = [
    ("büyücü", "wizard"), ("buyucu", "wizard"), ("sihirbaz", "wizard magician"), ("büyü", "magic"), ("zombi", "zombie"), ("vampir", "vampire"), ("korsan", "pirate"),
    ("uzay", "space"), ("casus", "spy"), ("kahraman", "hero"), ("kahramanlar", "heroes"), ("ejderha", "dragon"), ("korku", "horror"), ("gerilim", "thriller"),
    ("komedi", "comedy"), ("aksiyon", "action"), ("macera", "adventure"), ("romantik", "romance"), ("polisiye", "crime detective"), ("savaş", "war"), ("tarihi", "historical"),
    ("gizem", "mystery"), ("efsane", "legend"), ("strateji", "strategy"), ("futbol", "football soccer"), ("matriks", "matrix"), ("çocuk", "kids children"),
    ("cocuk", "kids children"), ("şövalye", "knight"), ("prenses", "princess"), ("hırsız", "thief"), ("katil", "killer"), ("dedektif", "detective"), ("uzaylı", "alien"), ("uzayli", "alien"),
]

# Words that name a category.
CATEGORY_HINTS = [
    ("oyun", "game"), ("game", "game"), ("games", "game"), ("rpg", "game"), ("film", "video"), ("filmler", "video"), ("movie", "video"), ("movies", "video"), ("sinema", "video"),
    ("dizi", "video"), ("diziler", "video"), ("series", "video"), ("belgesel", "video"), ("documentary", "video"), ("anime", "video"), ("animasyon", "video"), ("müzik", "audio"),
    ("muzik", "audio"), ("music", "audio"), ("şarkı", "audio"), ("sarki", "audio"), ("albüm", "audio"), ("album", "audio"), ("song", "audio"), ("songs", "audio"),
    ("kitap", "book"), ("kitab", "book"), ("book", "book"), ("books", "book"), ("ebook", "book"), ("roman", "book"), ("dergi", "book"), ("magazine", "book"),
    ("yazılım", "software"), ("yazilim", "software"), ("program", "software"), ("software", "software"), ("uygulama", "software"), ("app", "software"), ("apps", "software"),
]

# Suffixes that make a number a decade.
DECADE_SUFFIXES = ["ler", "lar", "lerin", "ların", "larin", "lerde", "larda", "s", "ler'in", "lı", "li"]
