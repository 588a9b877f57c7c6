"""Names, patterns and weights that results depend on. Lexicons of terms are configuration (``config.py``)."""

#: Query parameters that only track.
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_referrer", "traceinfo", "fbclid", "gclid", "msclkid", "ref", "referrer", "source")

#: Host part, platform; the first that the host contains.
PLATFORMS = (
    ("dealls.com", "dealls"), ("glints.com", "glints"), ("jobstreet.co.id", "jobstreet"), ("jobstreet.com", "jobstreet"), ("kalibrr.id", "kalibrr"),
    ("kalibrr.com", "kalibrr"), ("loker.id", "lokerid"), ("prosple.com", "prosple"), ("indeed.com", "indeed"), ("linkedin.com", "linkedin"),
)
PLATFORM_LABELS = {"glints": "Glints", "dealls": "Dealls", "kalibrr": "Kalibrr", "jobstreet": "Jobstreet", "linkedin": "LinkedIn", "prosple": "Prosple", "indeed": "Indeed", "lokerid": "Loker.id"}
#: Platforms whose listings may be followed to their details.
FOLLOWABLE = ("dealls", "glints", "kalibrr", "jobstreet", "prosple", "lokerid", "indeed")
SOURCE_QUALITY = {"dealls": 12, "glints": 12, "kalibrr": 10, "jobstreet": 10, "prosple": 8, "generic": 4}
PLATFORM_CAPS = {"dealls": 8, "glints": 18, "kalibrr": 8, "jobstreet": 18, "prosple": 8, "linkedin": 6, "indeed": 3, "generic": 12}

BINARY_ENDINGS = ("pdf", "doc", "docx", "xls", "xlsx", "zip", "rar", "png", "jpg", "jpeg", "gif", "mp4")
#: Paths of listing pages.
LISTING_PATHS = (
    r"^/loker/?$", r"^/loker/industri", r"^/loker/lokasi", r"^/loker/posisi", r"^/loker/tipe", r"^/loker/populer", r"/find-jobs", r"^/job-board", r"^/jobs/?$",
    r"^/id/[^/]+-jobs$", r"^/[^/]+-jobs$", r"^/id-ID/home", r"^/id-ID/job-board", r"/search", r"/kategori", r"/category", r"^/tipe-pekerjaan/magang", r"^/lowongan-magang",
    r"^/q-.*lowongan\.html", r"/about-us/karir/magang", r"/global/.*/actuarial-jobs", r"/go/Actuarial-Jobs", r"/internship-co-op", r"/about-aia/about-us/careers",
)
LISTING_TITLES = (
    r"^\d+\s+(?:pekerjaan|jobs?)\b", r"explore jobs", r"job vacancy.*opportunit", r"lowongan kerja di", r"find jobs", r"job board", r"cari lowongan", r"loker terbaru",
    r"browse jobs", r"anda sudah melihat semua pekerjaan",
)
#: Titles that the gate over results turns down.
BAD_TITLES = (r"explore jobs", r"lowongan kerja populer", r"lowongan kerja full.?time", r"lowongan kerja magang", r"lowongan kerja di indonesia", r"job vacancy.*opportunit", r"cari lowongan", r"browse jobs", r"find jobs")
DETAIL_URLS = (
    r"glints\.com/.*/opportunities/jobs/", r"dealls\.com/loker/[a-z0-9].*~", r"kalibrr\.(?:id|com)/.*/c/.+/jobs/\d+/", r"jobstreet\.co\.id/.*/job/",
    r"prosple\.com/.*/(?:jobs-internships|graduate-jobs-internships|job)/", r"linkedin\.com/jobs/view/", r"indeed\.com/.*/viewjob\?", r"loker\.id/.*/lowongan-kerja/",
    r"/careers?/.+", r"/jobs?/(?:view/)?\d+", r"/jobs?/[a-z0-9][a-z0-9-]+(?:[?#]|$)",
)
BAD_PATHS = (r"/blog", r"/article", r"/tips", r"/career-advice", r"/course", r"/bootcamp", r"/kelas", r"/login", r"/signup")
SEARCH_LISTING_URLS = (
    r"linkedin\.com/jobs/(?!view/)[^?#]*-jobs(?:[/?#-]|$)", r"jora\.com/lowongan-[^?#]*-di-[^?#]+", r"indeed\.[^/]+/q-[^?#]*lowongan", r"/jobs/search",
    r"/jobs/(?:search|collections|people|recommended)",
)

SKIP_SIGNALS = ("captcha", "recaptcha", "verify you are human", "access denied")
LOGIN_SIGNALS = ("login", "sign in", "log in", "masuk")
CLOSED_PAGE = (
    r"\bclosed\b", r"\bexpired\b", r"\bno longer accepting\b", r"\bnot accepting applications\b", r"\bjob is no longer available\b", r"\blowongan ditutup\b", r"\bditutup\b",
    r"\bkadaluarsa\b", r"\btidak menerima lamaran\b",
)
CLOSED_STATUS = (
    r"\bno longer accepting\b", r"\bnot accepting applications\b", r"\bjob is no longer available\b", r"\bposition is no longer available\b", r"\blowongan ditutup\b",
    r"\btidak menerima lamaran\b", r"\bkadaluarsa\b", r"\bexpired\b",
)
ACTIVE_SIGNALS = ("apply", "lamar", "daftar", "listed", "posted")

INTERN_TITLE = (r"\bintern\b", r"\binternship\b", r"\bmagang\b", r"\bapprentice\b", r"\bco-op\b")
TARGET_INTERN_TITLE = (*INTERN_TITLE, r"\btrainee\b", r"\bojt\b", r"\bpkl\b", r"\bpraktik\s+kerja\b")
PRIOR_INTERNSHIP = r"\b(?:prior|previous|past|relevant|required|preferred)\s+internship(?:s)?\b|\binternship(?:s)?\s+(?:experience|required|preferred)\b"
SENIOR_TITLE = (r"\bsenior\b", r"\bmanager\b", r"\blead\b", r"\bhead\b", r"\bhead\s+of\b", r"\bsupervisor\b", r"\bprincipal\b", r"\bdirector\b", r"\bvp\b", r"\bvice\s+president\b", r"\bchief\b")
EARLY_INTERN = ("intern", "internship", "magang", "trainee", "apprentice", "program magang", "kerja praktek", "praktik kerja", "co-op")
EARLY_SENIOR = ("senior", "manager", "director", "head of", "lead ", "supervisor", "principal", "vp ", "vice president", "chief ", "c-level")
EXTRA_STRONG = ("program magang", "mahasiswa magang", "internship program")

ROLE_NAMES = {
    "software_engineering": "Software Engineering", "frontend": "Frontend Developer", "backend": "Backend Developer", "fullstack": "Fullstack Developer", "mobile": "Mobile Developer",
    "qa": "Quality Assurance", "it_support": "IT Support", "data_analyst": "Data Analyst", "business_intelligence": "Business Intelligence", "data_engineer": "Data Engineer",
    "ai_ml": "AI/ML Engineer", "actuarial": "Actuarial", "ui_ux": "UI/UX Designer", "product": "Product Manager",
}
ROLE_CATEGORIES = {
    "Software Engineering": "tech", "Frontend Developer": "tech", "Backend Developer": "tech", "Fullstack Developer": "tech", "Mobile Developer": "tech", "Quality Assurance": "tech",
    "IT Support": "tech", "Data Analyst": "data", "Business Intelligence": "data", "Data Engineer": "data", "AI/ML Engineer": "data", "Actuarial": "actuarial",
    "UI/UX Designer": "design", "Product Manager": "product",
}
TOP_CATEGORIES = ("tech", "data", "actuarial", "design", "product")
TARGET_ALIASES = {
    "technology": "tech", "engineering": "tech", "software": "software_engineering", "software_engineer": "software_engineering", "frontend_developer": "frontend", "front_end": "frontend",
    "backend_developer": "backend", "back_end": "backend", "fullstack_developer": "fullstack", "full_stack": "fullstack", "mobile_developer": "mobile", "quality_assurance": "qa",
    "it": "it_support", "support": "it_support", "bi": "business_intelligence", "machine_learning": "ai_ml", "ml": "ai_ml", "ai": "ai_ml", "uiux": "ui_ux", "ui_ux_designer": "ui_ux",
    "product_manager": "product", "actuary": "actuarial", "aktuaria": "actuarial", "ai/ml_engineer": "ai_ml", "ai_ml_engineer": "ai_ml", "ui/ux_designer": "ui_ux",
}

MONTHS = (("januari", "January"), ("februari", "February"), ("maret", "March"), ("april", "April"), ("mei", "May"), ("juni", "June"), ("juli", "July"), ("agustus", "August"), ("september", "September"), ("oktober", "October"), ("november", "November"), ("desember", "December"))
DEADLINE_WORDS = ("deadline", "batas akhir", "penutupan", "ditutup", "apply before", "closed")
DATES = (
    r"\b\d{1,2}\s+(?:Januari|Februari|Maret|April|Mei|Juni|Juli|Agustus|September|Oktober|November|Desember|January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{4}\b",
)
SALARIES = (
    r"Rp\.?\s?\d{1,3}(?:[.,]\d{3}){1,3}", r"IDR\s?\d{1,3}(?:[.,]\d{3}){1,3}", r"\d+\s*[-–]\s*\d+\s*juta", r"\d+\s*juta",
    r"(?:uang saku|allowance|stipend)\s*[:]\s*(?:Rp\.?\s?\d[\d.,]+|\d+\s*juta)", r"\b(?:paid internship|unpaid internship|unpaid)\b",
)
SALARY_HIDDEN = ("perusahaan tidak menampilkan gaji", "gaji tidak ditampilkan", "salary not displayed", "salary undisclosed", "undisclosed salary")
SALARY_WORDS = ("uang saku", "allowance", "stipend", "salary", "gaji")
MONTH_DURATION = r"\b(\d{1,2})\s*(?:bulan|months?)\b"
WEEK_DURATION = r"\b(\d{1,2})\s*(?:minggu|weeks?)\b"
REMOTE = (r"\bwfh\b", r"\bwork\s+from\s+home\b", r"\bfull\s+remote\b", r"\bfully\s+remote\b")
ONSITE = (r"\bwfo\b", r"\bwork\s+from\s+office\b", r"\bonsite\b", r"\bon-site\b")
MIXED_EMPLOYMENT = (r"\bintern\s*/\s*staff\b", r"\bstaff\s*/\s*intern\b", r"\bintern\s+or\s+staff\b", r"\binternship\s*/\s*full[-\s]?time\b")
SPECIALIZATIONS = (
    ("game", (r"\bunity\b", r"\bgame\b", r"\bunreal\b")),
    ("mobile", (r"\bmobile\b", r"\bflutter\b", r"\bandroid\b", r"\bios\b", r"\bkotlin\b", r"\bswift\b")),
    ("frontend", (r"\bfront[-\s]?end\b", r"\bfrontend\b", r"\breact\b", r"\bvue\b", r"\bnext\.?js\b")),
    ("backend", (r"\bback[-\s]?end\b", r"\bbackend\b", r"\bapi\b", r"\bnode\.?js\b", r"\blaravel\b")),
    ("fullstack", (r"\bfull[-\s]?stack\b", r"\bfullstack\b")),
    ("web", (r"\bweb developer\b", r"\bweb\b")),
    ("data", (r"\bdata analyst\b", r"\bbusiness intelligence\b", r"\bbi\b", r"\bdashboard\b")),
    ("qa", (r"\bqa\b", r"\bquality assurance\b", r"\btester\b")),
)
TITLE_COMPANY = (r"^(.+?)\s+membuka\s+lowongan\b", r"\bdi\s+(.+?)(?:,\s*\||\s*\|\s*Glints|$)", r"\bat\s+(.+?)(?:,\s*\||\s*\|\s*Glints|$)", r"\bjobs?\s+at\s+(.+?)(?:,\s*\||\s*\|\s*Glints|$)")
TEXT_COMPANY = (
    r"(?:at|di|@)\s+([A-Z][A-Za-z\s&.]+?)(?:\s*[-–|,]|\s*$)", r"[-–—]\s*(?:PT\.?\s+)?([A-Z][A-Za-z\s&.]+?)(?:\s*[-–|,]|\s*$)", r"(?:PT\.?\s+)([A-Z][A-Za-z\s&.]+)",
    r"(?:perusahaan|company)[:\s]+([A-Za-z\s&.]+?)(?:\s*[-–|,.\n]|$)",
)
NO_COMPANY = ("indonesia", "linkedin", "glints", "jobstreet")
PLACE_COMPANY = r"^(?:jakarta|jakarta raya|indonesia|daerah istimewa yogyakarta|yogyakarta|bandung|surabaya|bali)(?:,\s*indonesia)?$"
SENTENCE_COMPANY = ("membantu", "mengembangkan", "maintenance", "melakukan", "bertanggung jawab", "assist", "develop", "maintain", "building", "build", "collaborate", "membuat", "merancang", "mengimplementasikan")
FOREIGN_PLACES = (r"\bgurugram\b", r"\bgurgaon\b", r"\bindia\b", r"\bdelhi\b", r"\bnoida\b", r"\bbengaluru\b", r"\bbangalore\b", r"\bmumbai\b", r"\bhyderabad\b")
NOT_LISTED, NOT_KNOWN = "Tidak dicantumkan", "Belum tersedia"

#: Points by condition.
OFFICIAL_SOURCES = ("jobstreet.co.id", "glints.com", "dealls.com", "kalibrr.id", "indeed.com", "linkedin.com", "prosple.com", "karir.com", "careers", "career", "jobs")
APPLY_SIGNALS = ("apply", "lamar", "daftar", "submit", "apply now", "lamar sekarang", "kirim lamaran", "register")
SCORES = {"internship_detected": 30, "role_detected": 25, "location_detected": 10, "apply_signal": 10, "deadline_detected": 10, "official_career_source": 10, "remote_bonus": 5, "paid_signal": 5}
PENALTIES = {"bootcamp": -40, "course": -35, "expired": -50}

EXPORT_COLUMNS = (
    "id", "score", "title", "company", "role", "category", "company_confidence", "location", "location_area", "work_mode", "duration", "salary", "salary_raw", "salary_display",
    "salary_min", "salary_max", "salary_confidence", "salary_status", "location_status", "duration_status", "deadline_status", "location_confidence", "deadline", "source_name",
    "source_platform", "source_url", "detail_url", "original_url", "is_internship", "internship_confidence", "role_confidence", "score_breakdown", "extraction_depth",
    "verification_level", "dashboard_quality", "active_status", "role_family", "role_group", "role_specialization", "mixed_employment_signal", "summary_short",
    "source_platform_label", "apply_url", "display_location", "display_salary", "page_type", "extraction_status", "summary", "first_seen", "last_seen",
)
DASHBOARD_COLUMNS = (
    "id", "title", "company", "role", "role_family", "role_group", "role_specialization", "category", "location", "location_area", "location_status", "work_mode", "salary_display",
    "salary_status", "duration", "duration_status", "deadline", "deadline_status", "source_platform", "source_platform_label", "source_url", "apply_url", "score", "dashboard_quality",
    "extraction_depth", "verification_level", "active_status", "mixed_employment_signal", "display_location", "display_salary", "summary_short", "first_seen", "last_verified_at",
)
DASHBOARD_REQUIRED = (
    "id", "title", "company", "role", "role_specialization", "category", "source_platform", "source_url", "score", "dashboard_quality", "extraction_depth", "verification_level",
    "active_status", "summary_short", "first_seen", "last_verified_at",
)
APPLICATION_COLUMNS = ("id", "user_id", "opportunity_id", "status", "notes", "applied_at", "created_at", "updated_at")
