"""Reply parsing, scores, prompts and dialogues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.prompts import format_prompt, load_prompts, transcript
from ..functions.replies import CLASSES, guess_to_label, parse_guess, parse_response, relevance_score
from ..operators import agents, evaluate
from . import bindings as b
from .registry import query, rounded, with_parts

REPLIES = """
replies AS (
  SELECT p_partkey AS reply_id, '1. **' || CASE p_partkey % 8 WHEN 0 THEN 'Glomerular tuft'
      WHEN 1 THEN 'Small blood vessel' WHEN 2 THEN 'Distal tubule segment'
      WHEN 3 THEN 'Proximal tubule segment' WHEN 4 THEN 'Interstitial space'
      WHEN 5 THEN 'Peritubular capillary bed' WHEN 6 THEN 'Collecting tubular duct'
      ELSE 'Unclassified tissue' END || '**:' || chr(10) || 'Supporting evidence: ' || p_name || chr(10) ||
    p_type || chr(10) || '2. **' || CASE p_partkey % 5 WHEN 0 THEN 'Proximal tubule wall'
      WHEN 1 THEN 'Distal tubule wall' WHEN 2 THEN 'Glomerular edge' WHEN 3 THEN 'Wide blood vessel'
      ELSE 'Immune infiltrate' END || '**:' || chr(10) || p_brand || chr(10) ||
    'Closing remarks that run on for longer than fifty characters: ' || p_name AS reply,
    CASE p_partkey % 6 WHEN 0 THEN 'Proximal tubules' WHEN 1 THEN 'Distal tubules' WHEN 2 THEN 'Glomeruli'
      WHEN 3 THEN 'Blood vessel' WHEN 4 THEN 'Interstitium' ELSE 'Other' END AS truth FROM part),
texts AS (
  SELECT 'p' || reply_id AS text_id, reply AS text FROM replies
  UNION ALL SELECT 'd' || doc_id, text FROM documents)"""

LINES = """
lines AS (
  SELECT text_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM texts),
starts AS (
  SELECT text_id, min(pos) FILTER (line LIKE '1.%') AS one, min(pos) FILTER (line LIKE '2.%') AS two
  FROM lines GROUP BY ALL),
heads AS (
  SELECT text_id, one AS pos, 2 AS reach FROM starts WHERE one IS NOT NULL
  UNION ALL SELECT text_id, two, 2 FROM starts WHERE two IS NOT NULL
  UNION ALL SELECT text_id, 1, 4 FROM starts WHERE one IS NULL AND two IS NULL),
guesses AS (
  SELECT h.text_id, h.pos, string_agg(l.line, chr(10) ORDER BY l.pos) AS guess
  FROM heads h JOIN lines l ON l.text_id = h.text_id AND (l.pos = h.pos OR (
    l.pos > h.pos AND l.pos <= h.pos + h.reach AND length(l.line) < 50
    AND lower(l.line) NOT LIKE '%evidence%'))
  GROUP BY ALL),
parsed AS (
  SELECT text_id, row_number() OVER (PARTITION BY text_id ORDER BY pos) - 1 AS guess_no, guess FROM guesses)"""

ITEMS = r"""
pieces AS (
  SELECT text_id, guess_no, unnest(string_split(cleaned, '*')) AS piece,
         generate_subscripts(string_split(cleaned, '*'), 1) AS pos
  FROM (SELECT *, replace(replace(replace(replace(guess, chr(10), ' '), '1.', ''), '2.', ''), ':', '') AS cleaned
        FROM parsed)),
items AS (
  SELECT text_id, guess_no, item, row_number() OVER (PARTITION BY text_id, guess_no ORDER BY pos) - 1 AS item_no
  FROM (SELECT *, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS item FROM pieces)
  WHERE length(item) > 5 AND length(item) < 100)"""

LABELS = """
labelled AS (
  SELECT *, CASE
    WHEN lower(item) LIKE '%glomerul%' OR lower(item) LIKE '%peritubular capillar%' THEN 'Glomeruli'
    WHEN lower(item) LIKE '%vasculature%' OR lower(item) LIKE '%blood vessel%' THEN 'Blood vessel'
    WHEN lower(item) LIKE '%distal%' AND lower(item) LIKE '%tub%' THEN 'Distal tubules'
    WHEN (lower(item) LIKE '%prox%' AND lower(item) LIKE '%tub%') OR lower(item) LIKE '%tubul%' THEN 'Proximal tubules'
    WHEN lower(item) LIKE '%interstiti%' OR lower(item) LIKE '%basement membrane%'
      OR lower(item) LIKE '%inflammatory%' OR lower(item) LIKE '%immune%' THEN 'Interstitium'
    ELSE 'NA' END AS label FROM items)"""

PREDICTED = """
predicted AS (
  SELECT reply_id, truth, label, row_number() OVER (PARTITION BY reply_id ORDER BY guess_no, item_no) AS pos
  FROM replies LEFT JOIN (SELECT * FROM labelled WHERE label <> 'NA') ON text_id = 'p' || reply_id)"""

PARSE = (REPLIES, LINES)


def texts(spark, sf_dir):
    """Numbered replies, and free text without numbers."""
    numbered = b.replies(spark, sf_dir).select(
        F.concat(F.lit("p"), "reply_id").alias("text_id"), F.col("reply").alias("text"))
    free = b.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("text_id"), "text")
    return numbered.unionByName(free)


def exploded_guesses(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "text_id", F.posexplode(parse_response(F.col("text"))).alias("guess_no", "guess"))


def exploded_items(spark, sf_dir):
    return exploded_guesses(spark, sf_dir).select(
        "text_id", "guess_no", F.posexplode(parse_guess(F.col("guess"))).alias("item_no", "item"))


@query(with_parts(*PARSE, select="SELECT text_id, CAST(guess_no AS INT) AS guess_no, guess FROM parsed"), name="parse_response")
def parse_response_lines(spark, sf_dir):
    return exploded_guesses(spark, sf_dir)


@query(with_parts(*PARSE, ITEMS, select="""
SELECT text_id, CAST(guess_no AS INT) AS guess_no, CAST(item_no AS INT) AS item_no, item FROM items"""), name="parse_guess")
def parse_guess_items(spark, sf_dir):
    return exploded_items(spark, sf_dir)


@query(with_parts(*PARSE, ITEMS, LABELS, select="""
SELECT text_id, CAST(guess_no AS INT) AS guess_no, CAST(item_no AS INT) AS item_no, label FROM labelled"""), name="guess_to_label")
def guess_labels(spark, sf_dir):
    return exploded_items(spark, sf_dir).withColumn("label", guess_to_label(F.col("item"))).drop("item")


@query(with_parts(*PARSE, ITEMS, LABELS, PREDICTED, select="""
SELECT CAST(k AS INT) AS k, count(*) AS n, count(*) FILTER (first_hit <= k) AS correct,
       round(count(*) FILTER (first_hit <= k) / count(*), 6) AS accuracy
FROM (SELECT reply_id, min(pos) FILTER (label = truth) AS first_hit FROM predicted GROUP BY ALL)
     CROSS JOIN (VALUES (1), (2), (3)) t(k) GROUP BY ALL"""))
def accuracy_at_k(spark, sf_dir):
    predictions = evaluate.with_predictions(b.replies(spark, sf_dir))
    return rounded(evaluate.accuracy_at_k(predictions), "accuracy")


NAMES = [(c, c.lower().replace(" ", "_")) for c in CLASSES]


@query(with_parts(*PARSE, ITEMS, LABELS, PREDICTED, select="SELECT c.truth, count(label) AS n, " + ", ".join(
    f"count(*) FILTER (label = '{c}') AS n_{n}, round(count(*) FILTER (label = '{c}') / nullif(count(label), 0), 6) AS share_{n}"
    for c, n in NAMES) + " FROM (VALUES " + ", ".join(f"('{c}')" for c in CLASSES) + """) c(truth)
LEFT JOIN (SELECT truth, label FROM predicted WHERE pos = 1 AND label IS NOT NULL) p ON p.truth = c.truth GROUP BY c.truth"""))
def confusion_matrix(spark, sf_dir):
    matrix = evaluate.confusion_matrix(evaluate.with_predictions(b.replies(spark, sf_dir)))
    return rounded(matrix, *[f"share_{n}" for _, n in NAMES])


@query(with_parts(*PARSE, ITEMS, select="""
SELECT reply_id, truth, item AS entry FROM replies JOIN items ON text_id = 'p' || reply_id WHERE guess_no = 0"""))
def guessed_entries(spark, sf_dir):
    return evaluate.entries_by_truth(b.replies(spark, sf_dir))


def _sql_text(agent: str, section: str, values: dict[str, str]) -> str:
    """A template as an SQL expression, for the comparison only."""
    text = load_prompts(agent)[section]["template"].replace("'", "''").replace("\n", "' || chr(10) || '")
    for name, sql in values.items():
        text = text.replace("{" + name + "}", f"' || {sql} || '")
    return f"('{text}')"


@query(f"""
SELECT doc_id, {_sql_text('omics_annotator', 'system',
                          {'tissue_types': 'lower(lang)', 'major_phenotypes': 'text'})} AS prompt FROM documents""")
def prompt_format(spark, sf_dir):
    section = load_prompts("omics_annotator")["system"]
    values = {"tissue_types": F.lower("lang"), "major_phenotypes": F.col("text")}
    return b.table(spark, sf_dir, "documents").select("doc_id", format_prompt(section, values).alias("prompt"))


DOCUMENT_VALUES = {
    "tissue_types": "lower(lang)", "major_phenotypes": "source", "context": "url",
    "bm_summary": "text", "ct_summary": "html", "seg_summary": "CAST(n_chars AS VARCHAR)"}


def _sql_dialogue(agent: str, parts: list[tuple[str, str]], values: dict[str, str]) -> str:
    out = "'---' || chr(10)"
    for i, (role, section) in enumerate(parts):
        lead = "" if i == 0 else "chr(10) || '---' || chr(10) || "
        content = section if section.startswith("(") else _sql_text(agent, section, values)
        out += f" || {lead}'{role}: ' || {content}"
    return out


@query("SELECT doc_id, " + _sql_dialogue("omics_annotator", [
    ("SYSTEM", "system"), ("HUMAN", "user_context"), ("HUMAN", "user_input"), ("HUMAN", "user_instruction")],
    DOCUMENT_VALUES) + " AS dialogue FROM documents JOIN pages ON page_id = doc_id % (SELECT count(*) FROM pages)")
def annotator_dialogue(spark, sf_dir):
    pages = b.table(spark, sf_dir, "pages").withColumnRenamed("page_id", "page")
    page = F.col("doc_id") % pages.count()
    rows = b.table(spark, sf_dir, "documents").withColumn("page", page).join(pages, "page")
    values = {k: F.expr(v.replace("VARCHAR", "STRING")) for k, v in DOCUMENT_VALUES.items()}
    return rows.select("doc_id", transcript(agents.annotator_dialogue(values)).alias("dialogue"))


AGGREGATED = """
sized AS (
  SELECT *, CAST(ceil(count(*) OVER (PARTITION BY lang, source) / 40) AS BIGINT) AS n_parts FROM documents),
joined AS (
  SELECT lang, source, doc_id % n_parts AS part, count(*) AS n_obs,
         string_agg(text, chr(10) || '===' || chr(10) ORDER BY doc_id) AS results
  FROM sized GROUP BY ALL)"""


def aggregated(spark, sf_dir):
    documents = b.table(spark, sf_dir, "documents")
    return agents.aggregate_texts(documents, ["lang", "source"], "text", "doc_id", per_prompt=40).drop("n_parts")


@query(with_parts(AGGREGATED, select="SELECT * FROM joined"))
def aggregate_texts(spark, sf_dir):
    return aggregated(spark, sf_dir)


AGGREGATE_VALUES = {"tissue_types": "lower(lang)", "major_phenotypes": "source", "context": "source",
                    "n_obs": "CAST(n_obs AS VARCHAR)", "results": "results"}


@query(with_parts(AGGREGATED, select="SELECT lang, source, part, " + _sql_dialogue("omics_annotator_aggregate", [
    ("SYSTEM", "system"), ("HUMAN", "context"), ("HUMAN", "input"), ("HUMAN", "instruction")],
    AGGREGATE_VALUES) + " AS dialogue FROM joined"))
def aggregate_dialogue(spark, sf_dir):
    values = {k: F.expr(v.replace("VARCHAR", "STRING")) for k, v in AGGREGATE_VALUES.items()}
    return aggregated(spark, sf_dir).select(
        "lang", "source", "part", transcript(agents.aggregate_dialogue(values)).alias("dialogue"))


PATHOLOGY_VALUES = {"tissue_types": "lower(c_mktsegment)", "major_phenotypes": "c_name",
                    "diagnosis": "c_mktsegment", "phenotype_desc": "c_name"}
QUESTION = ("(" + _sql_text("pathology_scorer", "user_final_input", PATHOLOGY_VALUES) + " || "
            + _sql_text("pathology_scorer", "user_instruction", PATHOLOGY_VALUES) + ")")


@query(with_parts("""
turns AS (
  SELECT conv_id, turn, role, text AS user_input,
         lead(text) OVER w AS ai_output, lead(role) OVER w AS next_role
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""", select="SELECT conv_id, turn, " + _sql_dialogue("pathology_scorer", [
    ("SYSTEM", "system"), ("HUMAN", "(user_input)"), ("AI", "(ai_output)"), ("HUMAN", QUESTION)],
    PATHOLOGY_VALUES) + """ AS dialogue FROM turns
JOIN customer ON c_custkey = conv_id % (SELECT max(c_custkey) + 1 FROM customer)
WHERE role = 'user' AND next_role = 'assistant' AND user_input IS NOT NULL AND ai_output IS NOT NULL"""))
def pathology_dialogue(spark, sf_dir):
    """A dialogue for every turn of a user that an assistant answers."""
    in_turn = Window.partitionBy("conv_id").orderBy("turn")
    turns = b.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("user_input"),
        F.lead("text").over(in_turn).alias("ai_output"), F.lead("role").over(in_turn).alias("next_role"))
    patients = b.table(spark, sf_dir, "customer")
    last = patients.agg(F.max("c_custkey")).first()[0] or 0
    answered = turns.where("role = 'user' AND next_role = 'assistant' AND user_input IS NOT NULL AND ai_output IS NOT NULL")
    rows = answered.join(patients, F.col("c_custkey") == F.col("conv_id") % (last + 1))
    values = {k: F.expr(v) for k, v in PATHOLOGY_VALUES.items()}
    values |= {"user_input": F.col("user_input"), "ai_output": F.col("ai_output")}
    return rows.select("conv_id", "turn", transcript(agents.pathology_dialogue(values)).alias("dialogue"))


@query(with_parts("""
scored AS (
  SELECT p_partkey AS reply_id, lower(replace(CASE p_partkey % 5
    WHEN 0 THEN '**Phenotype-driven interpretation**:' || chr(10) || '   ' || p_name || ', **' || p_size * 3 || '**' || chr(10)
                || '   1. ' || p_type || ', 12'
    WHEN 1 THEN p_name || ', [' || p_size || '/100]' || chr(10) || '1. ' || p_brand
    WHEN 2 THEN p_type || chr(10) || 'Relevance Score: ' || p_size || chr(10) || '1. x, 7'
    WHEN 3 THEN p_type || chr(10) || '1. ' || p_brand || ', 5' END, '*', '')) AS reply FROM part)""", r"""
found AS (
  SELECT reply_id,
    regexp_extract(regexp_replace(reply, '(?s)\n\s*1\..*', ''), '(?m),\s*\[?(\d{1,3})(?:/100)?\]?\s*$', 1) AS at_end,
    regexp_extract(reply, 'score\D{0,20}(\d{1,3})', 1) AS named FROM scored),
numbers AS (
  SELECT reply_id, CAST(coalesce(nullif(at_end, ''), nullif(named, '')) AS INT) AS score FROM found)""", select="""
SELECT reply_id, CASE WHEN score <= 100 THEN score END AS score FROM numbers"""))
def pathology_score(spark, sf_dir):
    """Relevance scores read from scorers' replies of several forms."""
    reply = F.expr(r"""CASE p_partkey % 5
      WHEN 0 THEN concat('**Phenotype-driven interpretation**:\n   ', p_name, ', **', p_size * 3, '**\n   1. ', p_type, ', 12')
      WHEN 1 THEN concat(p_name, ', [', p_size, '/100]\n1. ', p_brand)
      WHEN 2 THEN concat(p_type, '\nRelevance Score: ', p_size, '\n1. x, 7')
      WHEN 3 THEN concat(p_type, '\n1. ', p_brand, ', 5') END""")
    return b.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("reply_id"), relevance_score(reply).alias("score"))
