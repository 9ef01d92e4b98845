"""Word lists and weights."""

# They decide results. The taxonomy and lists come from an MIT-licensed source.
STRONG_VERBS = (
    "led", "built", "launched", "reduced", "increased", "designed", "implemented", "drove", "delivered", "scaled", "architected",
    "negotiated", "spearheaded", "optimized", "automated", "managed", "created", "improved", "generated", "streamlined", "orchestrated",
)
WEAK_OPENERS = ("responsible for", "duties included", "worked on", "helped with", "involved in", "tasked with", "in charge of")
STOP_WORDS = (
    "the", "and", "for", "with", "that", "this", "from", "into", "over", "across", "which", "were", "have", "has", "had", "was", "are",
    "will", "such", "their", "them", "they", "while", "when", "where", "these", "those", "than", "then", "also", "each", "more", "most",
    "some", "using", "used", "including", "within", "through", "about",
)
BUZZWORDS = (
    "results-driven", "results driven", "team player", "hard worker", "hardworking", "detail-oriented", "detail oriented",
    "self-starter", "self starter", "go-getter", "think outside the box", "synergy", "synergies", "dynamic", "passionate",
    "motivated individual", "excellent communication skills", "proven track record", "fast-paced environment", "wear many hats",
    "value add", "hit the ground running", "strategic thinker",
)
SENIORITY = {
    "intern": 0, "junior": 1, "associate": 1, "coordinator": 1, "analyst": 2, "specialist": 2, "engineer": 2, "consultant": 2,
    "senior": 3, "lead": 4, "principal": 4, "staff": 4, "manager": 5, "head": 6, "director": 7, "vp": 8, "vice president": 8,
    "svp": 9, "chief": 10, "cxo": 10, "ceo": 10, "cto": 10, "coo": 10, "cfo": 10,
}
SECTIONS = {
    "summary": ("summary", "professional summary", "profile", "about me", "career summary", "objective", "career objective", "professional profile"),
    "experience": ("experience", "work experience", "professional experience", "employment history", "work history", "relevant experience", "career history"),
    "education": ("education", "academic background", "education and training", "academic qualifications"),
    "skills": ("skills", "technical skills", "core competencies", "key skills", "skills & tools", "areas of expertise", "competencies"),
    "certifications": ("certifications", "certificates", "licenses", "licenses & certifications"),
    "projects": ("projects", "key projects", "personal projects", "selected projects"),
    "awards": ("awards", "honors", "awards and honors", "achievements"),
    "languages": ("languages", "language proficiency"),
    "contact": ("contact", "contact information", "personal information"),
    "interests": ("interests", "hobbies", "hobbies and interests"),
}
EXPECTED_ORDER = ("header_block", "summary", "experience", "education", "skills")
SKILLS = {
    "Python": ("hard", ("python", "python3", "py")),
    "JavaScript": ("hard", ("javascript", "js", "es6", "ecmascript")),
    "TypeScript": ("hard", ("typescript", "ts")),
    "SQL": ("hard", ("sql", "structured query language", "mysql", "postgresql", "postgres", "tsql")),
    "Java": ("hard", ("java", "j2ee", "jvm")),
    "React": ("hard", ("react", "react.js", "reactjs")),
    "Node.js": ("hard", ("node", "node.js", "nodejs")),
    "AWS": ("hard", ("aws", "amazon web services", "ec2", "s3", "lambda")),
    "Docker": ("hard", ("docker", "containerization", "containers")),
    "Kubernetes": ("hard", ("kubernetes", "k8s")),
    "Git": ("hard", ("git", "github", "gitlab", "version control")),
    "Machine Learning": ("hard", ("machine learning", "ml", "deep learning", "neural networks")),
    "Excel": ("hard", ("excel", "microsoft excel", "spreadsheets", "ms excel")),
    "Tableau": ("hard", ("tableau", "data visualization")),
    "Power BI": ("hard", ("power bi", "powerbi")),
    "A/B Testing": ("hard", ("a/b testing", "ab testing", "split testing", "experimentation")),
    "Data Analysis": ("hard", ("data analysis", "data analytics", "analytics")),
    "Product Management": ("hard", ("product management", "product manager", "pm")),
    "Project Management": ("hard", ("project management", "pmp", "program management")),
    "Agile": ("hard", ("agile", "scrum", "kanban", "sprint planning")),
    "Jira": ("hard", ("jira", "atlassian")),
    "Roadmapping": ("hard", ("roadmapping", "roadmap planning", "product roadmap")),
    "Figma": ("hard", ("figma", "wireframing", "prototyping")),
    "Salesforce": ("hard", ("salesforce", "crm", "sfdc")),
    "SEO": ("hard", ("seo", "search engine optimization")),
    "Content Marketing": ("hard", ("content marketing", "content strategy")),
    "Google Analytics": ("hard", ("google analytics", "ga4")),
    "Negotiation": ("soft", ("negotiation", "deal-making", "contract negotiation")),
    "Financial Modeling": ("hard", ("financial modeling", "financial analysis", "forecasting")),
    "QuickBooks": ("hard", ("quickbooks", "bookkeeping software")),
    "Leadership": ("soft", ("leadership", "team leadership", "people management")),
    "Communication": ("soft", ("communication", "verbal communication", "written communication")),
    "Problem Solving": ("soft", ("problem solving", "problem-solving", "critical thinking")),
    "Collaboration": ("soft", ("collaboration", "teamwork", "cross-functional collaboration")),
    "Time Management": ("soft", ("time management", "prioritization", "organization")),
    "Adaptability": ("soft", ("adaptability", "flexibility", "resilience")),
    "Mentorship": ("soft", ("mentorship", "coaching", "mentoring")),
    "Stakeholder Management": ("soft", ("stakeholder management", "stakeholder engagement")),
}
LEXICON = (
    "python", "java", "javascript", "typescript", "react", "next.js", "node.js", "express", "sql", "postgresql", "mongodb", "redis",
    "supabase", "aws", "docker", "kubernetes", "git", "linux", "c++", "rust", "go", "golang", "pytorch", "tensorflow", "scikit-learn",
    "pandas", "numpy", "machine learning", "deep learning", "nlp", "computer vision", "opencv", "llm", "rag", "langchain", "fastapi",
    "flask", "django", "spring boot", "graphql", "rest api", "ci/cd", "streamlit", "tailwind", "flutter", "kotlin", "figma", "power bi",
    "tableau", "data structures", "algorithms", "cloudflare", "gemini", "prompt engineering", "vector database", "mlops",
)
FIELD_WEIGHTS = {"full_name": 0.10, "email": 0.15, "phone": 0.10, "summary": 0.05, "experience": 0.30, "education": 0.10, "skills": 0.15, "sections": 0.05}
CATEGORY_WEIGHTS = {
    "ats_essentials": 0.12, "resume_sections": 0.13, "content_quality": 0.20, "job_tailoring": 0.15, "recruiter_red_flags": 0.15,
    "bias_and_discrimination": 0.05, "seniority_and_impact": 0.20,
}
SEVERITY = {"blocker": 1.0, "warning": 0.5, "info": 0.2}
CITY_CODES = {
    "Bengaluru": "BLR", "Hyderabad": "HYD", "Mumbai": "BOM", "Pune": "PNQ", "Delhi NCR": "DEL", "Chennai": "MAA", "Kolkata": "CCU",
    "Ahmedabad": "AMD", "Jaipur": "JAI", "Kochi": "COK", "Noida": "NOD", "Remote": "RMT",
}
RING_SKILLS = {
    "sde": ("DSA", "React", "Node.js", "SQL", "Git", "REST APIs", "OOP", "System Design"),
    "ai": ("Python", "PyTorch", "NumPy", "Pandas", "SQL", "Git", "ML basics", "Transformers"),
    "data": ("Python", "SQL", "Pandas", "Spark", "Airflow", "Git", "Statistics", "BigQuery"),
    "cloud": ("AWS", "Docker", "Kubernetes", "Terraform", "Linux", "CI/CD", "Networking", "Git"),
}
MARKET_DEFAULTS = {"demand_today": 75, "demand_2027": 82, "demand_2028": 88, "demand_2029": 93, "growth_probability": 85}
COMPANY_OPTIONS = {"product": "Product-based", "service": "Service-based or consulting", "startup": "Startup", "other": "Something else"}
#: Least and most characters of the fields of a request.
REQUEST_LENGTHS = {"resume_text": (80, 15000), "target_role": (2, 80), "city": (2, 60), "username": (0, 39)}
PHASES = ("intake", "check", "generate", "revise")
ANIMALS = (
    "Tiger", "Eagle", "Falcon", "Wolf", "Panther", "Cobra", "Lion", "Hawk", "Leopard", "Phoenix", "Dragon", "Bison",
    "Lynx", "Otter", "Rhino", "Jaguar", "Stag", "Owl", "Raven", "Cheetah", "Fox", "Bear", "Mantis", "Shark",
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Patterns. Word boundaries are spelt out in ASCII, so that every engine reads them alike.
QUANTIFIED = r"(\$\s?\d|[\d,]+%|(^|[^a-zA-Z0-9_])\d+[kKmMbB]?($|[^a-zA-Z0-9_]))"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(\+?\d{1,3}[\s.-]?)?(\(?\d{2,4}\)?[\s.-]?)?\d{3,4}[\s.-]?\d{3,4}"
PROFILE = r"(?i)(https?://)?(www\.)?linkedin\.com/in/[A-Za-z0-9\-_/]+"
UNPROFESSIONAL = r"(?i)\d{3,}|xoxo|sexy|420|69|cool|swag"
MESSY_FILE = r"(?i)final[\s_\-]*final|v\d+.*final|copy\s*of|_new_new|resume\d*\(\d+\)|untitled"
URL = r"https?://\S+"
LINK = r"https?://\S+|www\.\S+"
DATE_FORMATS = {
    "month_year": r"(^|[^A-Za-z0-9_])[A-Za-z]{3,9}\.?\s+\d{4}($|[^A-Za-z0-9_])",
    "numeric_slash": r"(^|[^A-Za-z0-9_])\d{1,2}/\d{4}($|[^A-Za-z0-9_])",
    "iso": r"(^|[^A-Za-z0-9_])\d{4}-\d{1,2}($|[^A-Za-z0-9_])",
}
BIRTH = r"(?i)(^|[^a-z0-9_])(date of birth|(?-i:DOB)|age[:\s]+\d{1,3})($|[^a-z0-9_])|(^|[^a-z0-9_])born\s+(on\s+)?\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
TENURE = r"(?i)(^|[^a-z0-9_])(\d{2,})\+?\s*years?\s+of\s+experience($|[^a-z0-9_])"
DATE_RANGE = (
    r"(?i)((?:[A-Za-z]+\.?\s+\d{4})|(?:\d{1,2}/\d{4})|(?:\d{4}))\s*(?:-|–|—|to)\s*((?:[A-Za-z]+\.?\s+\d{4})|(?:\d{1,2}/\d{4})|(?:\d{4})|Present|Current|Now)"
)
BULLET = r"^[\s\-•*●▪]+"
#: As the rule has always been applied: it takes ASCII letters and digits for unusual bullets; the other form is what was meant.
ODD_BULLET = {"compat": r"^[\x{2600}-\x{27BF}\x{1F30}0-\x{1FAF}F]", "fixed": r"^[\x{2600}-\x{27BF}\x{1F300}-\x{1FAFF}]"}
