"""Word lists, lookup tables, thresholds and text formats.

Every value below is a fixed value of the measurement method: results are only right when it is
exactly this. Rules that use the values live in `citescope/operators`.
"""

# --- fixed values: site domains -------------------------------------------------------------
# Public suffixes with more than one label. The full Public Suffix List is not shipped; pass your
# own list to `registrable_domain` to extend it.

# Fixed value: subject and topic particles, each between ASCII word characters.
ANSWER_PARTICLE = r"[A-Za-z0-9_](은|는|이|가|란)[A-Za-z0-9_]"

MULTI_LABEL_SUFFIXES = [
    "co.kr", "or.kr", "ne.kr", "re.kr", "pe.kr", "go.kr", "mil.kr", "ac.kr", "hs.kr", "ms.kr",
    "es.kr", "sc.kr", "kg.kr", "seoul.kr", "busan.kr", "daegu.kr", "incheon.kr", "gwangju.kr",
    "daejeon.kr", "ulsan.kr", "gyeonggi.kr", "gangwon.kr", "chungbuk.kr", "chungnam.kr",
    "jeonbuk.kr", "jeonnam.kr", "gyeongbuk.kr", "gyeongnam.kr", "jeju.kr",
    "co.uk", "org.uk", "ac.uk", "gov.uk", "ltd.uk", "plc.uk", "me.uk", "net.uk", "nhs.uk",
    "co.jp", "or.jp", "ne.jp", "ac.jp", "go.jp", "ad.jp", "ed.jp", "gr.jp", "lg.jp",
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "id.au", "co.nz", "org.nz", "net.nz",
    "ac.nz", "govt.nz", "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "ac.cn", "com.tw",
    "org.tw", "edu.tw", "gov.tw", "com.hk", "org.hk", "edu.hk", "gov.hk", "com.sg", "org.sg",
    "edu.sg", "gov.sg", "com.my", "org.my", "co.in", "org.in", "net.in", "gov.in", "ac.in",
    "co.id", "or.id", "ac.id", "go.id", "co.th", "or.th", "ac.th", "go.th", "com.vn", "edu.vn",
    "gov.vn", "com.ph", "com.br", "org.br", "gov.br", "com.mx", "org.mx", "com.ar", "com.tr",
    "co.za", "org.za", "co.il", "org.il",
]
PLATFORM_DOMAINS = [
    "naver.com", "kakao.com", "daum.net", "instagram.com", "facebook.com", "youtube.com",
    "youtu.be", "tiktok.com", "twitter.com", "x.com", "linkedin.com", "blog.me", "tistory.com",
    "modoo.at", "imweb.me", "wix.com", "cafe24.com", "makeshop.co.kr", "my-doctor.io",
    "goodoc.co.kr", "ddocdoc.com", "modoodoc.com", "gangnamunni.com", "babitalk.com",
    "google.com", "wikipedia.org", "namu.wiki",
]
# Host patterns of redirectors: anywhere in the host, or its end.
REDIRECT_HOSTS = [
    r"[^/?#:]*vertexaisearch\.cloud\.google\.com[^/?#:]*",
    r"[^/?#:]*\.bing\.com",
    r"[^/?#:]*translate\.goog",
    r"[^/?#:]*webcache\.googleusercontent\.com[^/?#:]*",
]
REDIRECT_PARAMS = ["url", "u", "q", "target", "dest", "r"]
MAX_URL_LENGTH = 2048
ALLOWED_PORTS = ["80", "443"]

# --- fixed values: address ranges that are not public ---------------------------------------
BLOCKED_V4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24),
    ("224.0.0.0", 4), ("240.0.0.0", 4),
]
# Same for the 32 hex digits of an expanded IPv6 address: ::, ::1, fc00::/7, fe80::/10, ff00::/8,
# 2002::/16, 64:ff9b::/96.
BLOCKED_V6_HEX = (
    r"^(?:0{31}[01]|f[cd].*|fe[89ab].*|ff.*|2002.*|0064ff9b0{16}.*)$"
)

# --- fixed values: engines -------------------------------------------------------------------
ENGINES = [
    # engine, measure mode, weight in Korea, path of the citations in a response
    ("chatgpt", "auto-api", "medium",
     "output[type=message].content[type=output_text].annotations[type=url_citation].url"),
    ("claude", "auto-api", "medium",
     "content[].citations[](type='web_search_result_location').url"),
    ("perplexity", "auto-api", "medium",
     "search_results[].url (+ top-level citations[]); message.content 의 [n] 마커"),
    ("gemini", "checklist", "high",
     "candidates[].groundingMetadata.groundingChunks[].maps.{uri,placeId}/.web.uri"),
    ("naver", "checklist", "high",
     "AI브리핑 API 없음(육안); Local API items[].link / items[].address"),
]
AUTO_ENGINES = ["chatgpt", "claude", "perplexity"]
DEFAULT_BUSINESS = "치과"
# (needs district, needs procedure, refuses district, refuses procedure, template)
QUERY_TEMPLATES = [
    (False, False, False, False, "{d} {p} 잘하는 {b} 추천해줘"),
    (False, False, False, False, "{d}에서 {p} {b} 비교"),
    (False, False, False, False, "{d} {b} 추천"),
    (False, False, False, False, "{d} {p} 비용이 얼마예요"),
    (True, True, False, False, "{d} 출퇴근하는데 {p} 할 {b} 어디가 좋아?"),
    (True, True, False, False, "{d} 근처 {p} {b} 아무데나 예약해도 괜찮을까?"),
    (True, True, False, False, "{p} 해야 하는데 {d} 쪽 어디 가면 돼?"),
    (True, True, False, False, "{p} {d} 잘하는 데 어딘지 알려줘"),
    (True, True, False, False, "{d}에서 {p} 잘해준다는 {b} 찾는데 추천해줘"),
    (True, False, False, True, "{d} 근처 {b} 아무데나 괜찮은 곳 있어?"),
    (False, True, True, False, "{p} 잘하는 {b} 추천해줘"),
]
BASE_TEMPLATES = 4
SYSTEM_TEXT = "You are helping a user in {d} find a {b}. Use web search."
SYSTEM_DEFAULT_PLACE = "한국"
FORCE_SEARCH_NOTE = "반드시 web_search 도구를 사용해 최신 웹 정보를 검색한 후 답변하세요."
DEFAULT_MODELS = {"chatgpt": "gpt-4o", "claude": "claude-sonnet-4-6", "perplexity": "sonar"}
MAX_CUSTOM_QUERIES = 3
MAX_REPEATS = 3
MAX_REGIONS = 5
COST_NOTE = "%d지역 × %d엔진 × %d질의 × %d회 = %d회 호출"
WILSON_Z = 1.96
MAX_CITED_DOMAINS = 15
MAX_SAMPLE_ANSWERS = 3
SAMPLE_ANSWER_CHARS = 1400
SINGLE_REPEAT_NOTE = "1회 측정이라 회차 변동은 관측되지 않았습니다. 반복 측정으로만 확인됩니다."
NAME_NOISE = r"""[\s\u00a0\u3000\ufeff()\[\]{}·.,~!?'"“”‘’\-–—_/|:]+"""

# --- fixed values: crawler registry ----------------------------------------------------------
BOTS = [
    # token, operator, category
    ("OAI-SearchBot", "OpenAI", "citation"),
    ("PerplexityBot", "Perplexity", "citation"),
    ("ClaudeBot", "Anthropic", "citation"),
    ("Claude-SearchBot", "Anthropic", "citation"),
    ("Googlebot", "Google", "citation"),
    ("Applebot", "Apple", "citation"),
    ("meta-externalagent", "Meta", "citation"),
    ("Amazonbot", "Amazon", "citation"),
    ("ChatGPT-User", "OpenAI", "user"),
    ("Perplexity-User", "Perplexity", "user"),
    ("Claude-User", "Anthropic", "user"),
    ("GPTBot", "OpenAI", "training"),
    ("Google-Extended", "Google", "training"),
    ("CCBot", "Common Crawl", "training"),
    ("Applebot-Extended", "Apple", "training"),
    ("Bytespider", "ByteDance", "training"),
    ("anthropic-ai", "Anthropic", "legacy"),
    ("Claude-Web", "Anthropic", "legacy"),
]
EVIDENCE_PATHS = ["/", "/blog/", "/column/", "/board/", "/doctors/", "/about/"]
ROBOTS_ABSENT_NOTE = "robots.txt 없음/판정불가 (SPA fallback 또는 미존재)"
ROBOTS_OPEN_NOTE = "AI 크롤러 차단 없음(허용)"
ROBOTS_CITATION_NOTE = "인용 경로 봇 차단: "
ROBOTS_PARTIAL_NOTE = "일부 경로 차단: "
ROBOTS_TRAINING_NOTE = "학습용 봇만 차단(인용 경로는 허용): "
BOT_DETECTION_IDS = [
    ("GPTBot", [123815556, 33563875]),
    ("OAI-SearchBot", [126255384, 33563986]),
    ("ChatGPT-User", [132995013, 33563857]),
    ("ClaudeBot", [33563859]),
    ("Claude-SearchBot", [33564301]),
    ("Claude-User", [33564303]),
    ("PerplexityBot", [33563889]),
    ("Perplexity-User", [33564371]),
]
UA_BOTS = [
    "OAI-SearchBot", "PerplexityBot", "ClaudeBot", "Claude-SearchBot", "ChatGPT-User",
    "Perplexity-User", "Claude-User", "GPTBot",
]
AI_MEDIUM = "ai-assistant"
# engine -> crawler operator and referral host, for the three-stage funnel
FUNNEL_LINKS = [
    ("chatgpt", "OpenAI", "chatgpt.com"),
    ("claude", "Anthropic", "claude.ai"),
    ("perplexity", "Perplexity", "perplexity.ai"),
]

# --- fixed values: Korean address parts ------------------------------------------------------
SIDO = [
    ("서울특별시", "서울"), ("서울시", "서울"), ("서울", "서울"),
    ("부산광역시", "부산"), ("부산시", "부산"), ("부산", "부산"),
    ("대구광역시", "대구"), ("대구시", "대구"), ("대구", "대구"),
    ("인천광역시", "인천"), ("인천시", "인천"), ("인천", "인천"),
    ("광주광역시", "광주"), ("광주시", "광주"), ("광주", "광주"),
    ("대전광역시", "대전"), ("대전시", "대전"), ("대전", "대전"),
    ("울산광역시", "울산"), ("울산시", "울산"), ("울산", "울산"),
    ("세종특별자치시", "세종"), ("세종시", "세종"), ("세종", "세종"),
    ("경기도", "경기"), ("경기", "경기"),
    ("강원특별자치도", "강원"), ("강원도", "강원"), ("강원", "강원"),
    ("충청북도", "충북"), ("충북", "충북"),
    ("충청남도", "충남"), ("충남", "충남"),
    ("전북특별자치도", "전북"), ("전라북도", "전북"), ("전북", "전북"),
    ("전라남도", "전남"), ("전남", "전남"),
    ("경상북도", "경북"), ("경북", "경북"),
    ("경상남도", "경남"), ("경남", "경남"),
    ("제주특별자치도", "제주"), ("제주도", "제주"), ("제주", "제주"),
]
DISTRICT = "[가-힣]{1,6}(?:시|군|구)"
ROAD = "[가-힣A-Za-z0-9]{1,10}(?:로|길|동|가)"
DISTRICT_TOKEN = "[가-힣]{1,5}(?:시|군|구)(?![가-힣])"
DONG_TOKEN = "([가-힣]{1,5}(?:동|읍|면))(?![가-힣])"
METRO_SUFFIX = "(?:특별자치시|특별자치도|특별시|광역시)$"
SIDO_TAIL = "(?:특별자치시|특별자치도|특별시|광역시|자치시|자치도|시|도)$"
REGION_TERMS = [
    "강남", "강동", "강북", "강서", "관악", "광진", "구로", "금천", "노원", "도봉",
    "동대문", "동작", "마포", "서대문", "서초", "성동", "성북", "송파", "양천", "영등포",
    "용산", "은평", "종로", "중구", "중랑",
    "강남역", "역삼", "선릉", "삼성", "잠실", "홍대", "신촌", "여의도", "목동", "노량진",
    "수유", "미아", "왕십리",
    "수원", "성남", "분당", "판교", "용인", "수지", "고양", "일산", "안양", "평촌", "부천",
    "안산", "화성", "동탄", "남양주", "의정부", "광명", "시흥", "군포", "하남", "김포", "파주",
    "이천", "인천", "부평", "송도", "계양", "연수",
    "부산", "해운대", "서면", "동래", "대구", "수성", "대전", "둔산", "유성", "광주", "울산",
    "세종", "천안", "청주", "전주", "창원", "김해", "포항", "제주",
]

# --- fixed values: page text patterns (Java regex syntax) ------------------------------------
CREDENTIAL_TERMS = "전문의|치의학박사|박사|원장|면허|교수|DDS|DMD|레지던트|수련의"
PHONE = r"0\d{1,2}[-.\s]?\d{3,4}[-.\s]?\d{4}"
STATISTIC = (
    r"\d[\d,]*(?:\.\d+)?\s*(?:%p|%|퍼센트포인트|퍼센트|배|명|건|례)"
    r"|\d[\d,]*(?:\.\d+)?\s*(?:mm|cm|mg|ml)(?![A-Za-z])"
)
REVIEW_BOX = r"(?i)(?:^|[^a-zA-Z])(?:review|testimonial)|후기|리뷰"
REVIEW_CITE = (
    r"(?:님|씨)\s*$|후기|리뷰|환자\s*(?:이야기|사례|경험)|고객\s*(?:의\s*)?소리|내원\s*경험"
    r"|보호자|어머님|아버님"
)
REVIEW_HEADING = r"후기|리뷰|치료\s*경험|환자\s*이야기|고객\s*의?\s*소리"
SOURCE_LABEL = (
    r"(?i)^(?:참고\s*문헌|참고\s*자료|참고|출처|자료\s*출처|인용\s*문헌|인용\s*자료|references?"
    r"|reference\s*list|bibliography|sources?|citations?)\s*[:：]?$"
)
# \b is written as an ASCII look-behind: the letters around it may be Hangul.
SOURCE_INLINE = (
    r"(?i)참고\s*문헌|참고\s*자료|자료\s*출처|출처\s*[:：\-–—]|인용\s*[:：]"
    r"|(?<![A-Za-z0-9_])References?\s*[:：]|(?<![A-Za-z0-9_])Bibliography(?![A-Za-z0-9_])"
    r"|(?<![A-Za-z0-9_])Sources?\s*[:：]"
)
NON_SOURCE_HOSTS = [
    "instagram.com", "facebook.com", "fb.com", "youtube.com", "youtube-nocookie.com", "youtu.be",
    "twitter.com", "x.com", "tiktok.com", "threads.net", "linkedin.com", "pinterest.com",
    "band.us", "naver.com", "naver.me", "kakao.com", "kakaocdn.net", "daum.net", "tistory.com",
    "brunch.co.kr", "blogspot.com", "wordpress.com", "jsdelivr.net", "cloudflare.com",
    "googleapis.com", "gstatic.com", "google.com", "goo.gl", "bit.ly", "w3.org", "schema.org",
    "wa.me", "t.me",
]
AUTHORITY_HOSTS = [
    "go.kr", "ac.kr", "edu", "gov", "arxiv.org", "doi.org", "nih.gov", "who.int", "nature.com",
    "sciencedirect.com", "springer.com", "springeropen.com", "wiley.com", "jamanetwork.com",
    "bmj.com", "thelancet.com", "nejm.org", "cochrane.org", "koreamed.org", "kci.go.kr",
    "riss.kr", "dbpia.co.kr", "medric.or.kr", "kda.or.kr", "nhis.or.kr", "hira.or.kr",
    "health.kr", "wikipedia.org", "wikidata.org",
]
SAME_AS_AUTHORITY = (
    r"(?i)wikidata\.org|wikipedia\.org|namu\.wiki|naver\.me|health\.kr|nhis\.or\.kr|kda\.or\.kr"
)
SOCIAL_HOSTS = [
    "instagram.com", "youtube.com", "youtu.be", "facebook.com", "blog.naver.com", "pf.kakao.com",
]
SOURCE_CONTAINER_TAGS = ["p", "li", "td", "dd", "blockquote", "cite", "figcaption"]
SOURCE_CONTAINER_CLASSES = [
    "references", "refs", "reference", "citation", "footnotes",
]
QUESTION_MARKS = "[?？]"
QUESTION_HOW = "어떻게(?!든)"
QUESTION_ENDINGS = [
    "나요|가요|까요|니까",
    "(?<![하제구무마러이거지미세유예소리다])나",
    "얼마나?|무엇|어디|언제",
]
QUESTION_NOT_BEFORE = "(?!단가|원가|정가|편지)"
PRICE_ITEM = (
    "임플란트|교정|크라운|보철|충치|신경치료|스케일링|잇몸|치아미백|라미네이트|사랑니|틀니|브릿지|인레이"
)
PRICE_AMOUNT = (
    r"(?<![-\d])\d{1,3}(?:,\d{3})+\s*원|(?<![-\d])\d+\s*(?:만|천만|억)\s*원"
)
PRICE_NOTICE = r"비급여\s*(?:진료비|진료 비용|항목|안내|고지)|진료비용\s*안내|가격표|수가표"
QUOTED = "“[^”\\n]{20,300}”|「[^」\\n]{20,300}」|\"[^\"\\n]{20,300}\""
BOOKING = r"(?i)예약|문의|상담|reservation|booking|appointment|contact|consult"
MAP_EMBED = r"(?i)(?:maps\.google\.|google\.com/maps|place_id=)"
DENTAL_TYPE = r"(?i)^(?:Dentist|MedicalClinic|MedicalBusiness|LocalBusiness|MedicalOrganization)$"
TRUST_TYPE = r"(?i)^(?:Person|Organization|MedicalWebPage|Article|BreadcrumbList|WebSite)$"
NAME_SPLIT = "[|–—:·ㅣ-]"
SHELL_IDS = ["root", "app", "__next", "__nuxt"]
PROCEDURES = [
    # query term, label, keywords
    ("임플란트", "임플란트", ["임플란트", "implant"]),
    ("치아교정", "치아교정", ["교정", "인비절라인", "invisalign", "투명교정"]),
    ("충치치료", "충치치료", ["충치", "레진", "인레이", "온레이"]),
    ("신경치료", "신경치료", ["신경치료", "근관치료"]),
    ("사랑니발치", "사랑니", ["사랑니", "매복치"]),
    ("라미네이트", "라미네이트", ["라미네이트", "라미네잇"]),
    ("치아미백", "미백", ["미백"]),
    ("스케일링", "스케일링", ["스케일링"]),
    ("보철", "보철(크라운)", ["보철", "크라운", "브릿지", "온레이"]),
    ("틀니", "틀니", ["틀니", "의치"]),
    ("소아치과", "소아치과", ["소아치과", "어린이치과", "소아진료"]),
    ("턱관절", "턱관절", ["턱관절", "악관절"]),
    ("잇몸치료", "잇몸치료", ["잇몸", "치주", "풍치"]),
    ("구강검진", "검진", ["정기검진", "구강검진", "구강검사"]),
]

# --- fixed values: the nine score items ------------------------------------------------------
METHODOLOGY_VERSION = "v0.4"
# key, label, maximum, layer, axis, why
SCORE_ITEMS = [
    ("crawl", "AI 크롤러 허용", 15, "SEO", "tech",
     "AI 크롤러가 막히면 인용 자체가 불가능합니다."),
    ("schema", "구조화 데이터(JSON-LD)", 10, "AEO", "tech",
     "JSON-LD는 상호·진료·의료진을 AI가 기계적으로 읽게 해줍니다."),
    ("price", "비급여 진료비 안내", 5, "AEO", "tech",
     "환자가 가장 많이 묻는 질문이고, 가격이 없는 페이지는 AI 답변에서 걸러진다는 통제 실험 결과가 있습니다."),
    ("extract", "추출성(S/N)", 10, "AEO", "tech",
     "본문 텍스트가 충분해야 AI가 추출·인용할 내용이 있습니다."),
    ("local", "엔티티·로컬 정합", 10, "SEO", "tech",
     "상호·주소·전화가 일치해야 지역 질의에서 엔티티로 잡힙니다."),
    ("eeat", "E-E-A-T(작성자·자격)", 15, "GEO", "content",
     "의료(YMYL) 주제는 작성자 자격이 있어야 AI가 신뢰합니다."),
    ("fresh", "신선도", 10, "SEO", "content",
     "날짜가 없거나 오래된 페이지는 AI 답변에서 걸러진다는 통제 실험 결과가 있습니다."),
    ("answer", "Answer-first 구조", 10, "GEO", "content",
     "질문에 결론부터 답하는 구조라야 AI가 그대로 발췌합니다."),
    ("citable", "인용 근거(출처·인용구·통계)", 15, "GEO", "content",
     "출처·인용구·수치가 있는 문단이 AI 답변에 그대로 발췌되기 쉽습니다(KDD 2024 실측 상위 3개 기법)."),
]
LIMITED_PREFIX = "측정 제한(JS 렌더로 본문 미확인 · 실패 아님) — "
BANDS = ["초기 단계", "개선 여지 큼", "보통", "우수"]
BAND_CUTS = [30, 50, 75]
BAND_CAP = "보통"
# code, label
BAND_GATES = [
    ("crawl-blocked", "AI 크롤러 차단"),
    ("no-citable-evidence", "인용 근거 0점"),
    ("measurement-limited", "측정 제한(JS 렌더)"),
]
GAIN_LABEL = "구조 위생 점수 · AI 인용 예측 아님"
SCORE_DISCLAIMER = (
    "이 점수는 AI 인용을 예측하지 않습니다. 홈페이지 구조 위생과 인용 가능 조건을 보는 휴리스틱 지표입니다. "
    "인용 여부는 실측 패널로만 확인됩니다."
)
FIX_TEXT = {
    "crawl-blocked": "robots.txt에서 %s 차단 해제 — 이 봇들이 막히면 답변 출처에 실릴 수 없습니다",
    "crawl-partial": "robots.txt에서 %s 경로 차단 해제 — 인용 근거가 실리는 위치입니다",
    "crawl-absent": "robots.txt를 두고 AI 크롤러(OAI-SearchBot·PerplexityBot 등) 허용을 명시",
    "schema-dental": "Dentist/MedicalClinic + LocalBusiness JSON-LD 추가(상호·주소·전화·진료)",
    "schema-trust": "Person(의료진)·Organization·Article 스키마로 작성 주체를 명시",
    "schema-authority": "sameAs에 공식 채널·인증기관 링크를 연결해 같은 병원임을 교차 확인 가능하게",
    "price": "주요 비급여 항목과 금액을 같은 표에 게시(의료법상 고지 의무 항목이기도 합니다)",
    "extract": "본문 텍스트 비중↑·불필요 스크립트/광고 정리(서버 렌더 권장)",
    "local": "NAP(상호·주소·전화)를 본문 + 스키마에 일관되게(플레이스 정보와 일치)",
    "eeat": "의료진 전문의/면허/경력을 본문 + Person 스키마로 명시",
    "fresh": "콘텐츠에 게시일/수정일(datePublished·article:modified_time) 노출",
    "answer": "진료별 질문형 H2 + 표/Q&A 블록으로 answer-first 구조화",
    "citable-sources": "본문 주장에 근거 출처를 명시(학회·논문·공공기관 링크 또는 참고문헌 표기)",
    "citable-quotes": "의료진 코멘트를 인용구(blockquote)로 배치해 발췌 가능한 형태로",
    "citable-stats": "수치 근거(증례 수·경과 기간·비율)를 본문에 병기",
}
NOTE_TEXT = {
    "crawl-absent": "robots.txt 없음/판정불가 (암묵 허용이나 명시 권장)",
    "schema-none": "JSON-LD 구조화 데이터 없음",
    "schema-empty": "있음",
    "price-table": "가격표 형태로 게시",
    "price-items": "진료 항목·금액 %d건",
    "price-notice": "비급여 고지 문구만 있음(금액 미표기)",
    "price-none": "진료비 안내 없음",
    "extract": "가시 텍스트 비율 %.1f%%, script %d개%s",
    "extract-render": " · JS 렌더 필요(크롤러 가시성 제한)",
    "local": "전화 %s · 주소 %s · 진료 스키마 %s",
    "eeat": "의료진 자격 신호 %d건, sameAs(SNS/블로그) %d건",
    "fresh": "게시일/수정일 신호 %d건",
    "answer": "질문형 H2 %d개, 표 %d개, FAQ블록 %d개",
    "citable": "출처 표기 %s · 인용구 %s · %s",
    "stats": ["통계 없음", "통계 일부", "통계 충분"],
}
CAP_NOTE = "%s — 점수는 %d점이지만 상한 등급('%s')을 보류했습니다."
VERDICTS = [
    (75, "AI가 인용하기 좋은 구조를 잘 갖추고 있습니다."),
    (50, "기본기는 갖췄고, 몇 가지만 보완하면 인용 가능성이 더 올라갑니다."),
    (30, "개선 여지가 큽니다 — 아래 항목이 채워지면 AI가 찾기 쉬워집니다."),
    (None, "아직 AI가 인용할 구조가 거의 비어 있습니다. 좋은 소식은, 대부분 몇 가지 수정으로 채울 수 있다는 점입니다."),
]
FORM_COVERAGE_GATE = 0.8
FORM_PLACEHOLDER_MAX = 0.3
FORM_THRESHOLDS_VERSION = "v0.1"

# --- fixed values: diagnosis -----------------------------------------------------------------
STRUCTURE_OK_SCORE = 70
# code -> severity, blocking, title, check, action
FINDINGS = {
    "not-measured": (
        "info", False, "이번 회차는 판정이 나오지 않았습니다",
        "유효 회차 수를 먼저 확인하십시오. 0이면 미인용이 아니라 미측정입니다.",
        "반복 측정으로 유효 회차를 확보한 뒤 판정합니다."),
    "crawl-blocked": (
        "high", True, "AI 인용 경로가 robots.txt로 막혀 있습니다",
        "주소창에 도메인/robots.txt 를 넣어 Disallow 대상을 직접 확인하실 수 있습니다.",
        "robots.txt에서 인용 경로 봇 차단을 해제합니다. 이 항목이 해결되기 전에는 다른 작업의 효과를 관측할 수 없습니다."),
    "js-rendered": (
        "high", True, "본문이 자바스크립트로만 그려져 크롤러가 읽지 못합니다",
        "브라우저에서 페이지 소스 보기를 열어, 눈에 보이는 본문 글자가 HTML에 실제로 있는지 확인하십시오.",
        "홈페이지를 갈아엎지 않고, 서버에서 바로 읽히는 진료 설명 페이지를 별도로 얹는 방식으로 해결합니다."),
    "named-not-linked": (
        "medium", False, "이름은 언급되는데 홈페이지가 출처로 걸리지 않습니다",
        "답변에 실제로 걸린 출처 도메인 목록을 보십시오. 디렉터리·플랫폼이 대신 인용되고 있는지 확인됩니다.",
        "홈페이지 손질이 아니라, 외부에 병원명·지역·진료 조합의 언급을 쌓는 작업으로 풉니다."),
    "prompt-gap": (
        "medium", False, "%s: 질문에 따라 결과가 갈립니다",
        "인용되지 않은 질의: %s",
        "인용되지 않은 질의의 주제를 다루는 페이지가 있는지 먼저 확인합니다. 없으면 그 주제가 비어 있는 것입니다."),
    "structure-ok-not-exposed": (
        "medium", False, "읽히는 조건은 갖췄지만 이번 측정에서는 답변에 나오지 않았습니다",
        "경쟁 상황이므로 우리 페이지만 봐서는 알 수 없습니다. 실제로 인용된 도메인이 무엇인지 함께 보십시오.",
        "구조가 아니라 근거의 양을 늘리는 단계입니다. 아래 비어 있는 항목부터 채웁니다."),
    "no-citable-evidence": (
        "high", False, "인용할 근거 문단이 없습니다",
        "본문에 출처 링크·전문가 인용구·수치가 하나라도 있는지 보십시오.",
        "진료 설명에 근거 출처와 수치를 병기합니다. 실측 상위 3기법에 해당하는 항목입니다."),
    "no-price": (
        "medium", False, "비급여 진료비 안내가 없습니다",
        "주요 비급여 항목과 금액이 같은 표에 있는지 확인하십시오.",
        "가격표를 게시합니다. 의료법상 고지 의무 항목이기도 해 우선순위가 높습니다."),
    "no-date": (
        "medium", False, "게시일·수정일이 노출되지 않습니다",
        "콘텐츠에 날짜가 표시되는지 확인하십시오.",
        "게시일·수정일을 노출합니다. 날짜가 없는 페이지가 걸러진다는 통제 실험 결과가 있습니다."),
}
NOT_MEASURED_DETAIL = {
    "no-search": "엔진이 이 회차에 웹 검색을 하지 않아 인용 여부를 관측할 수 없었습니다.",
    "engine-error": "엔진 호출 오류로 관측이 이뤄지지 않았습니다.",
    "other": "측정 가능한 엔진이 없었습니다.",
}
NAMED_DETAIL = "%s에서 병원명은 답변에 나왔지만 인용 링크는 다른 도메인이었습니다."
PROMPT_GAP_DETAIL = "측정한 %d개 질의 중 %d개는 항상 인용됐고 %d개는 한 번도 인용되지 않았습니다."
STRUCTURE_OK_DETAIL = (
    "구조 점수 %d점으로 기술 요건은 통과했습니다. 즉 막혀서 못 나온 것이 아니라, 같은 질문에 대해 다른 곳이 "
    "선택되고 있는 상태입니다."
)
RENDER_DETAIL = "JS 렌더 필요"
HEADLINES = {
    "unmeasured": "이번 회차는 판정이 나오지 않았습니다(미측정). 미인용과 다릅니다.",
    "blocked": "먼저 해결해야 할 필요조건이 막혀 있습니다. 이 상태에서는 다른 작업의 효과를 관측할 수 없습니다.",
    "exposed": "이번 측정에서 답변에 노출됐습니다. 아래는 노출 폭을 넓히기 위해 비어 있는 항목입니다.",
    "absent": "읽히는 조건은 확인됐지만 이번 측정에서는 답변에 나오지 않았습니다.",
    "structure": "구조 진단 기준의 결과입니다. 실제 인용 여부는 별도 실측으로 확인합니다.",
}
SEVERITY_ORDER = ["high", "medium", "info"]

# --- fixed values: comparison ----------------------------------------------------------------
EFFECT_LABEL = "구조 위생 지표 · AI 인용 예측 아님"
# key, difficulty, follow-up ids, why
COMPARED_SIGNALS = [
    ("crawl", "하", ["geo-diagnosis"],
     "AI 크롤러가 차단되면 페이지가 인용 후보에서 아예 제외됩니다(필요조건)."),
    ("schema", "중", ["content-hub", "geo-diagnosis"],
     "JSON-LD가 있으면 상호·진료·FAQ를 AI가 기계적으로 식별합니다."),
    ("eeat", "중", ["content-hub", "media-feature"],
     "의료(YMYL) 주제는 작성자 자격 신호가 있어야 신뢰 근거가 생깁니다."),
    ("citable", "중", ["blog-posting", "content-hub"],
     "출처·인용구·수치가 붙은 문단이 답변에 그대로 발췌되기 쉽습니다(KDD 2024 실측 상위 3개 기법)."),
    ("answer", "상", ["content-hub"],
     "질문에 결론부터 답하는 구조라야 본문이 그대로 발췌되기 쉽습니다."),
    ("fresh", "하", ["blog-posting"],
     "게시·수정일이 노출되면 최신성 판단 근거가 됩니다."),
    ("extract", "중", ["content-hub"],
     "본문 가시 텍스트 비중이 충분해야 추출할 내용이 존재합니다."),
    ("local", "하", ["content-hub", "geo-diagnosis"],
     "상호·주소·전화(NAP)가 일치해야 지역 질의에서 엔티티로 잡힙니다."),
]
# key, item, target, detail, difficulty, severity, follow-up ids
EXTRA_PLAN_ROWS = {
    "citability": ("콘텐츠 인용성 신호", "진료 설명 본문에 수치·인용·출처 표기를 보강",
                   "제3자 콘텐츠(블로그·기고)에서 동일 신호를 함께 축적", "중", 9.0,
                   ["blog-posting", "media-feature"]),
    "notcited": ("AI 미인용 — 외부 언급 부재", "지역+진료 조합의 제3자 언급을 단계적으로 축적",
                 "기술 점수와 별개로, AI 인용은 외부 언급 신호에 좌우됩니다", "상", 999.0,
                 ["blog-posting", "media-feature", "reboot-30"]),
}
CITABILITY_CURRENT = "약함 (%s 부족)"
NOTCITED_CURRENT = "제3자 콘텐츠(블로그·기사·커뮤니티) 언급이 적음"
PLAN_TARGET_DEFAULT = "구조 위생 항목 보완"
PLAN_CURRENT_DEFAULT = "미충족"
PLAN_SCHEMA_DETAIL = "비교 대상에 있는 필드: "
SCHEMA_FIELDS = [
    ("name", "상호 (name)"), ("telephone", "전화 (telephone)"), ("address", "주소 (address)"),
    ("openingHours", "진료시간 (openingHours)"), ("geo", "좌표 (geo)"),
    ("sameAs", "SNS·권위 링크 (sameAs)"), ("priceRange", "가격대 (priceRange)"),
    ("areaServed", "진료지역 (areaServed)"), ("medicalSpecialty", "전문분야 (medicalSpecialty)"),
]
META_FIELDS = [
    ("title", "title 태그"), ("description", "meta description"), ("ogTitle", "og:title"),
    ("ogImage", "og:image"), ("canonical", "canonical"), ("viewport", "viewport"),
]
META_ROBOTS = ("robots", "robots 메타", "(없음)")
CONTENT_NUMBERS = [
    ("h1", "H1 개수", "h1_count"), ("h2", "H2 개수", "h2_count"),
    ("questionH2", "질문형 H2", "question_h2"), ("tables", "표(table)", "tables"),
    ("faqBlocks", "FAQ 블록", "faq_blocks"), ("wordCount", "본문 글자수", "visible_len"),
]
CONTENT_FLAGS = [
    ("statistics", "수치·통계 ≥2", "has_statistics"),
    ("quotations", "인용문", "has_quotations"),
    ("citedSources", "출처 표기", "has_cited_sources"),
]
# follow-up id, rule (always / not cited / not cited or low score)
FOLLOW_UPS = [
    ("geo-diagnosis", "always"), ("content-hub", "uncited-or-low"), ("blog-posting", "uncited"),
    ("media-feature", "uncited"), ("geo-column", "always"), ("reboot-30", "uncited"),
    ("geo-renewal", "uncited-or-low"), ("ai-column", "uncited"), ("shortform", "uncited"),
]
FOLLOW_UP_LOW_SCORE = 70
SOLUTIONS = [
    ("geo-renewal", ["schema", "meta", "answer", "extract", "local", "crawl"]),
    ("ai-column", ["notcited", "citability", "eeat", "fresh"]),
    ("shortform", ["notcited", "citability"]),
]

# --- fixed values: place listings ------------------------------------------------------------
PLACE_PAGE_SIZE = 30
PLACE_URL = "https://map.naver.com/v5/entry/place/"
PLACE_SUFFIXES = "치과의원|치과병원|교정과|한의원|클리닉|덴탈|치과|병원|의원"
LOCAL_TOP = 5
PLACE_GAPS = [
    # code, gap, action
    ("booking-missing", "네이버 예약 리뷰 0건 — 예약 미운영 또는 이용 초기",
     "예약 오픈 + 플레이스 정보(NAP·진료시간·사진) 완결성 정비"),
    ("place-unmatched", "플레이스 매칭 실패 — 기본 정보 정합부터",
     "예약 오픈 + 플레이스 정보(NAP·진료시간·사진) 완결성 정비"),
    ("owned-content", "네이버 AI 인용의 70%가 블로그·카페(공식) — 병원 소유 콘텐츠 필요",
     "정보형(원인·방법·주의사항) 구조의 블로그 발행 — 임상사진·경험담 배제, 출처 명시"),
    ("clip-video", "AI브리핑이 클립 영상을 인용(ASR·OCR로 음성·자막을 읽음)",
     "대본=완결 정보 문장 + 화면 자막 필수의 주의사항 숏폼을 공식 클립 계정에 축적"),
    ("review-gap", "경쟁 상위 대비 리뷰 수 격차",
     "진료 후 케어 메시지에 실환자 리뷰 요청 연동(대가 제공 없음)"),
    ("monthly-watch", "AI 추천은 고정·로테이션이 섞여 매번 변동",
     "월 1회 같은 조건 재측정으로 변화 추적"),
]
GAP_RATIO_TEXT = "격차 ×%s"
GAP_LARGE_TEXT = "격차 큼"
GAP_AHEAD_TEXT = "우위"

# --- fixed values: history, quality, governance ----------------------------------------------
HISTORY_KEEP = 30
HISTORY_DAYS = 90
TREND_POINTS = 12
STALE_MAX_DAYS = 21
MONTHLY_FIELDS = [
    ("natural_visit_rate", 100.0), ("call_clicks", 1e6), ("direction_clicks", 1e6),
    ("reservations", 1e6), ("saves", 1e6),
]
FORBIDDEN_COPY = (
    r"(?i)최고|1\s*위|넘버\s*원|No\.?\s*1|유일|완치|보장|보증|100\s*%|최상급|명품"
)
NEWS_KEYWORDS = (
    r"(?i)ai search|generative engine|geo|aeo|ai overview|sge|chatgpt|perplexity|answer engine"
    r"|citation|grounding|ai mode|gemini|copilot|llm"
)
NEWS_PER_FEED = 6
LEAD_LIMITS = [
    ("domain", 200), ("clinic_name", 100), ("contact_name", 100), ("phone", 30), ("email", 200),
    ("notes", 1000),
]
LEAD_STATUS_NEW = "신규"
# What a lead from the public form carries where the form has no field.
PUBLIC_LEAD = {"source": "public", "contact": "(public form)", "product": "inquiry", "note": "[public form] "}
LEADS_PER_HOUR = 5
CACHE_HOURS = 24

# --- fixed values: manual checklists ---------------------------------------------------------
# checklist, item id, weight or mode
CHECKLIST_ITEMS = [
    ("gemini", "gbp-verified", "high"), ("gemini", "gbp-nap", "high"),
    ("gemini", "gbp-category", "high"), ("gemini", "gbp-services", "medium"),
    ("gemini", "gbp-hours", "medium"), ("gemini", "gbp-photos", "medium"),
    ("gemini", "gbp-website", "medium"), ("gemini", "gbp-reviews", "high"),
    ("gemini", "gbp-geocode", "medium"), ("gemini", "gbp-nap-web", "medium"),
    ("gemini", "gbp-schema", "low"),
    ("naver", "place-relevance", "high"), ("naver", "place-complete", "high"),
    ("naver", "place-popularity", "high"), ("naver", "place-trust", "high"),
    ("naver", "place-blog", "high"), ("naver", "place-eeat", "medium"),
    ("naver", "place-aeo", "medium"), ("naver", "place-jisikin", "low"),
    ("setup", "ga4-sa", "auto-connector"), ("setup", "cf-token", "auto-connector"),
    ("setup", "gsc-rollout", "manual"), ("setup", "gbp-manager", "manual"),
    ("setup", "naver-login", "manual"), ("setup", "utm-chatgpt", "manual"),
]
