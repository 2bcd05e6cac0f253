"""Closed vocabularies of the graph. Fixed values."""

NODE_TYPES = ["foaf:Person", "schema:Legislation", "schema:Organization", "schema:Place", "skos:Concept"]
NODE_TYPE_REMAPS = {"schema:Person": "foaf:Person", "foaf:Organization": "schema:Organization"}
DISCOURSE = ["RESPONDS_TO", "AGREES_WITH", "DISAGREES_WITH", "QUESTIONS"]
PREDICATES = ["AMENDS", "GOVERNS", "MODERNIZES", "AIMS_TO_REDUCE", "REQUIRES_APPROVAL", "IMPLEMENTED_BY", "RESPONSIBLE_FOR", "ASSOCIATED_WITH", "CAUSES", "ADDRESSES", "PROPOSES", *DISCOURSE]
PREDICATE_REMAPS = {"AGREE_WITH": "AGREES_WITH", "DISAGREE_WITH": "DISAGREES_WITH", "AIMS_TO": "AIMS_TO_REDUCE", "QUESTION": "QUESTIONS"}
GENERIC_LABELS = ["government", "member", "bill", "act", "law", "legislation", "parliament", "committee", "minister", "house", "scheme", "system", "program", "policy"]
PRIORS = {"GOVERNS": 0.15, "RESPONSIBLE_FOR": 0.12, "IMPLEMENTED_BY": 0.12, "AMENDS": 0.10, "AIMS_TO_REDUCE": 0.10, "PROPOSES": 0.08, "ADDRESSES": 0.08, "ASSOCIATED_WITH": 0.07, "CAUSES": 0.06, "MODERNIZES": 0.05, "REQUIRES_APPROVAL": 0.04, "RESPONDS_TO": 0.02, "AGREES_WITH": 0.005, "DISAGREES_WITH": 0.005, "QUESTIONS": 0.005}
#: What isn't in PRIORS weighs this much.
OTHER_PRIOR = 0.1
#: Words that search terms leave out, and words that keywords leave out.
QUERY_STOPWORDS = "the and for with from that this what when where which about into over under have has had".split()
KEYWORD_STOPWORDS = "the and or of to for in on by with a an be it this that".split()
#: Words that show a query's topic, and words of government that show none.
TOPIC_TERMS = """water bwa drought irrigation flood drainage housing home homeless property rent squatter tourism visitor hotel cruise beach coast
education school university student teacher health hospital doctor nurse clinic cancer hiv economy gdp inflation tax revenue budget
crime police prison murder robbery gang climate climate-change carbon emission renewable solar agriculture farm crop livestock food fishing
transport road bus traffic bridge airport employment job unemployment worker labour social welfare pension elderly disabled""".split()
GENERIC_TERMS = """minister ministers ministry government cabinet parliament house senate bill legislation law regulation policy amendment motion
debate speech member mp senator speaker chairman chairperson resolution committee report order paper""".split()
RECENCY_TERMS = "recent recently latest last new current".split()
CHAMBERS = "house senate assembly".split()
#: Role labels that are honours, not roles.
HONOURS = "sc s.c. kc k.c. jp j.p.".split()
