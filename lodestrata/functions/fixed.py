"""Word lists, patterns and constants that results depend on.

They must stay exactly as they are; changing one changes results.
"""

# Words that full-text queries leave out.
QUERY_STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for "
    "on with at by from as into about this that these those it its my your our their what which who whom how when where why all "
    "each every both some any no not and or but"
).split()

# Words that keyword queries built from prompts leave out.
PROMPT_STOP_WORDS = (
    "the a an and or but if then else with of to for in on at by from is are was were be been being have has had do "
    "does did will would could should can may might i you we they he she it this that these those my your our their its as "
    "so not no yes please help me about what when how why which where who there here also"
).split()

# Words that rule matching leaves out.
RULE_STOP_WORDS = (
    "a an the and or but if then of for to in on at by with from this that these those is are was were be been being have has had do does did "
    "will would should could can may might must i you we they it my your our their its about as so not no any some all one two three"
).split()

# Groups of names for one thing; the first is the name that counts.
NAME_ALIASES = (
    ("postgresql", "postgres", "pg"),
    ("javascript", "js"),
    ("typescript", "ts"),
    ("kubernetes", "k8s"),
    ("new york city", "nyc"),
    ("nodejs", "node.js", "node"),
    ("react.js", "reactjs", "react"),
    ("vue.js", "vuejs", "vue"),
    ("python", "py"),
    ("mongodb", "mongo"),
)

# Capitalised words that are no entities.
STOP_TOKENS = (
    "The This That These Those When Where Why How What Who Which If And But Or So For Nor Yet As At By On In To From With Without "
    "Into Onto Upon Over Under Between Among "
    "Add Remove Set Get Update Delete Create List Search Find Run Build Use Make Test Check Read Write Edit Save Load Open Close Start "
    "Stop Show Hide Push Pull Fix Done Skip Wait Try Note Warn Info Debug Trace Todo Fixme Should Could Would Must Will Shall Can May Might "
    "Mon Tue Wed Thu Fri Sat Sun Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
    "Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec January February March April June July August September October November December"
).split()

# Short technical names that are entities all the same.
TECH_NAMES = "go php bun deno npm pip gem vim git vue zod nuxt vite hono ai ml db os ui ux io ci cd k8s sdk orm jwt ssh dns gpu cpu".split()

# Names that a clean-up removes from the entity graph.
NOISE_NAMES = (
    "begin week,end week,begin day,end day,test,testing,tests,todo,todos,fix,bug,error,warning,success,failure,result,results,"
    "start,stop,begin,end,run,running,true,false,null,undefined,none,yes,no,ok,okay,step 1,step 2,step 3,step 4,step 5,"
    "phase 1,phase 2,phase 3,phase 4,part 1,part 2,part 3,item,items,thing,things,stuff,data,file,files,folder,path,"
    "input,output,response,request,user,admin,system,server,client,the,a,an,this,that"
).split(",")

# Lines that record a decision.
DECISION = (
    r"\bwe (?:decided|chose|picked|went with|agreed|confirmed)\b",
    r"\blet'?s (?:go with|use|do|keep|drop|switch|move)\b",
    r"\bdecision:\s",
    r"\bconfirmed:\s",
    r"\bapproved:\s",
    r"\brejected:\s",
    r"\bwon'?t (?:do|use|implement|add|need)\b",
    r"\bmust (?:use|have|be|support|include)\b",
    r"\bnon-negotiable\b",
    r"\brequirement:\s",
    r"\bconstraint:\s",
    r"\bchose .+ (?:over|instead of|rather than)\b",
    r"\bdropped?\b.+\bin favo(?:u)?r of\b",
)

# Attempts to take over a model, by family.
ROLE_OVERRIDE = (
    r"ignore\s+(all\s+)?previous\s+(instructions|prompts|rules)",
    r"you\s+are\s+now\s+",
    r"new\s+instructions?\s*:",
    r"forget\s+(everything|all|your)\s+(you|instructions|rules)",
    r"override\s+(your|the|all)\s+(instructions|rules|prompt)",
    r"disregard\s+(your|the|all|previous)\s+(instructions|rules|prompt)",
    r"ignoriere\s+alle",
    r"ignora\s+todas",
    r"ignorez\s+toutes",
    r"(?:forget|erase|clear|wipe|reset)\s+(?:everything|conversation|memory|context|history|all)",
    r"(?:from\s+now\s+on\s+you\s+are|act\s+as\s+if\s+you\s+are|pretend\s+you\s+are|your\s+new\s+role\s+is)",
)
PROMPT_EXTRACTION = (
    r"print\s+(your|the)\s+system\s+prompt",
    r"show\s+(me\s+)?(your|the)\s+(system\s+)?prompt",
    r"what\s+(is|are)\s+your\s+(system\s+)?(prompt|instructions|rules)",
    r"repeat\s+(your|the)\s+(system\s+)?(prompt|instructions)",
    r"output\s+(your|the)\s+(system\s+)?prompt\s+verbatim",
    r"(?:reveal|disclose|show|display|print|output|dump)\s+(?:your\s+)?(?:instructions|system\s+prompt|rules|guidelines|configuration|training)",
)
INSTRUCTION_INJECTION = (
    r"IMPORTANT\s*:\s*(ignore|disregard|forget|override)",
    r"SYSTEM\s*:\s*",
    r"\[INST\]",
    r"<<SYS>>",
    r"\bASSISTANT\s*:\s*",
    r"BEGIN\s+NEW\s+INSTRUCTIONS",
    r"(?:system\s+message|admin\s+message|admin\s+override|elevated\s+privileges|root\s+access|operator\s+mode|maintenance\s+mode|debug\s+mode)",
)

# Markers of a prohibition; the apostrophe comes in several forms.
_APO = "['‘’ʼ`]?"
NEGATION = (
    rf"\bdon{_APO}t\b",
    r"\bdo not\b",
    r"\bnever\b",
    r"\bavoid\b",
    r"\bno\s+(?:more\s+)?\b",
    r"\bstop(?:\s+(?:doing|using))?\b",
    r"\brefuse(?:s|d)?\s+to\b",
    rf"\bwon{_APO}t\b",
    rf"\bshouldn{_APO}t\b",
    r"\bmust not\b",
    rf"\bmustn{_APO}t\b",
)

# Questions for a reason.
WHY = (
    r"\bwhy(?:\s+(?:did|do|does|are|is|am|were|was|would|should|don't|didn't))",
    r"\bwhat\s+(?:was|is)\s+the\s+reason\b",
    r"\bhow\s+come\b",
    r"\bwhat\s+made\s+(?:me|us|you)\b",
    r"\bwhat\s+drove\s+(?:me|us|the)\s+decision",
    r"\b(?:reason|rationale|motivation)\s+(?:for|behind)\b",
    r"\bdecided\s+to\b",
    r"\bwhy(?:\?|$)",
)

# Reports of a failure, and of one that is over.
FAILURE = (
    r"\b(failed|failure|broke|broken|crashed|crashing|crash)\b",
    r"\b(bug|regression)\b",
    r"\b(did not|didn't|doesn't|wasn't|isn't|won't|hasn't|hadn't) work(ing|s|ed)?\b",
    r"\bnot working\b",
    r"\b(timed out|timeout|hung|hangs|hanged)\b",
    r"\b(threw|throws|throwing) (an? )?error\b",
    r"\b(blew up|blew-up)\b",
)
RESOLVED = (
    r"\bbug fix(ed|es|ing)?\b",
    r"\b(fixed|resolved|closed|patched|landed) (the )?bug\b",
    r"\bregression test\b",
    r"\bonce we (fixed|resolved|patched)\b",
    r"\bafter the fix\b",
)

# Frames that only keep books.
BOOKKEEPING = r"^\s*(\[wiki-synth\s|\[hm\s+session:[^\]]*\bevent:(user-prompt-submit|post-tool-use)\b)"

FRAME_TYPES = ("I", "P", "B")
IMPORTANCES = ("critical", "important", "normal", "temporary", "deprecated")
IMPORTANCE_WEIGHTS = {"critical": 2.0, "important": 1.5, "normal": 1.0, "temporary": 0.7, "deprecated": 0.3}
#: temporal, popularity, contextual, importance
PROFILES = {"balanced": (0.4, 0.2, 0.2, 0.2), "recent": (0.6, 0.1, 0.2, 0.1), "important": (0.1, 0.1, 0.2, 0.6), "connected": (0.1, 0.1, 0.6, 0.2)}
HALF_LIFE_DAYS, FLAT_DAYS = 30, 7
RRF_K, BM25_K1, BM25_B, BM25_FLOOR = 60, 1.2, 0.75, 1e-6
RERANK_POOL, DETAIL_POOL, DETAIL_KEEP = 30, 60, 6
NEAR_DUPLICATE, CONTRADICTION = 0.75, 0.40


def any_of(patterns, flags: str = "(?i)") -> str:
    """One pattern that matches where any of ``patterns`` does."""
    return flags + "(?:" + "|".join(patterns) + ")"

# Cues of dates in questions and texts.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "sunday monday tuesday wednesday thursday friday saturday".split()
_MONTH = "(" + "|".join(MONTHS) + ")"
WEEK_OF_MONTH = rf"(first|second|third|fourth|last)\s+week\s+of\s+{_MONTH}\s+(\d{{4}})"
THIRD_OF_MONTH = rf"(early|mid|late)\s+{_MONTH}\s+(\d{{4}})"
DAY_FIRST = rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?{_MONTH},?\s+(\d{{4}})"
MONTH_FIRST = rf"{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})"
MONTH_ALONE = rf"{_MONTH}\s+(\d{{4}})"
YEAR_ALONE = r"\b(?:in|during)\s+(20\d{2})\b"
NUMBER_AGO = r"\b(\d{1,3})\s+(day|week|month|year)s?\s+ago\b"
ONE_AGO = r"\ba\s+(week|month|year)\s+ago\b"
LAST_WEEKDAY = rf"\blast\s+({'|'.join(WEEKDAYS)})\b"
ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"

# How a page becomes text: elements left out, patterns and what replaces them, entities.
HTML_LEFT_OUT = ("script", "style", "nav", "footer", "header")
HTML_BREAKS = ((r"(?i)</p>", "\n\n"), (r"(?i)<br\s*/?>", "\n"), (r"(?i)<li[^>]*>", "\n- "), (r"<[^>]+>", ""))
HTML_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
HTML_TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HTML_DESCRIPTIONS = (
    r"""(?is)<meta[^>]*name=["']description["'][^>]*content=["'](.*?)["'][^>]*>""",
    r"""(?is)<meta[^>]*content=["'](.*?)["'][^>]*name=["']description["'][^>]*>""",
)
