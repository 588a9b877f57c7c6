"""A small lexicon and pages in the engine's own domain."""

from sluice.config import Lexicon

LEXICON = Lexicon.from_dict(
    {
        "internship_terms": {"strong": ["internship", "magang", "program magang"], "weak": ["mahasiswa", "fresh graduate"]},
        "non_internship_terms": ["senior", "full time"],
        "role_keywords": {
            "software_engineering": {"strong_titles": ["software engineer", "programmer"], "supporting_skills": ["git", "python", "java"], "exclude_titles": ["sales engineer"]},
            "frontend": {"strong_titles": ["frontend", "front-end"], "supporting_skills": ["react", "css", "html", "vue"], "exclude_titles": ["backend"]},
            "fullstack": {"strong_titles": ["fullstack", "software engineer"], "supporting_skills": ["react"], "exclude_titles": []},
            "actuarial": {"strong_titles": ["actuarial", "actuary"], "supporting_skills": ["pricing", "reserving"], "exclude_titles": []},
        },
        "locations": {"indonesia": ["indonesia"], "jakarta_area": ["jakarta", "jakarta selatan"], "other": ["solo", "bali", "balikpapan"]},
        "work_modes": {"hybrid": ["wfo/wfh"], "remote": ["remote"], "onsite": ["di kantor"]},
        "negative_terms": {"hard_reject": ["bootcamp", "kelas online"], "likely_not_job": ["artikel"], "suspicious_roles": ["content creator", "sales"]},
    }
)
