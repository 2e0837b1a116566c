"""Jargon and its plain words."""

# Fixed values, applied in this order.
PLAIN = {
    "pursuant to": "according to",
    "hereinafter": "from now on called",
    "notwithstanding": "despite",
    "aforementioned": "mentioned earlier",
    "inter alia": "among other things",
    "prima facie": "at first look",
    "bona fide": "genuine",
    "force majeure": "events beyond control (like natural disasters)",
    "de facto": "in practice",
    "de jure": "by law",
    "ipso facto": "by that very fact",
    "mutatis mutandis": "with necessary changes",
    "pro rata": "proportionally",
    "vis-a-vis": "compared to",
    "inter se": "among themselves",
    "gemäß": "nach",
    "aufgrund": "wegen",
    "hinsichtlich": "bezüglich",
    "diesbezüglich": "dazu",
    "unbeschadet": "ohne zu beeinträchtigen",
    "data subject": "the person whose data is being processed",
    "data controller": "the organization that decides how data is used",
    "data processor": "a company that handles data on behalf of another",
    "legitimate interest": "a valid business reason",
    "DPIA": "Data Protection Impact Assessment (a privacy risk check)",
    "GDPR": "GDPR (the EU's main data protection law)",
    "AI Act": "AI Act (the EU's law regulating artificial intelligence)",
}
LATIN = [r"(?:et al|etc|e\.g\.|i\.e\.|viz|cf|ibid|supra|infra)", r"(?:per se|ex parte|ad hoc|pro bono|quid pro quo)"]
PASSIVE = r"(?:is|are|was|were|been)\s+[a-z0-9_]+ed"
