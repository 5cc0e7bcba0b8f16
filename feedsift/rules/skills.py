"""Default skill dictionary."""

from __future__ import annotations

# Fixed values: (label, pattern), matched without regard to case.
SKILLS = (
    ("Python", r"\bpython\b"),
    ("Java", r"\bjava\b"),
    ("JavaScript", r"\bjavascript\b"),
    ("TypeScript", r"\btypescript\b"),
    ("SQL", r"\bsql\b"),
    ("Go", r"\bgolang\b"),
    ("C++", r"c\+\+"),
    ("C#/.NET", r"c#|c-sharp|\.net\b"),
    ("Scala", r"\bscala\b"),
    ("Kotlin", r"\bkotlin\b"),
    ("Rust", r"\brust\b"),
    ("AWS", r"\baws\b|amazon web services"),
    ("Azure", r"\bazure\b"),
    ("GCP", r"\bgcp\b|google cloud"),
    ("Spark", r"\bspark\b"),
    ("Hadoop", r"\bhadoop\b"),
    ("Kafka", r"\bkafka\b"),
    ("Airflow", r"\bairflow\b"),
    ("dbt", r"\bdbt\b"),
    ("Snowflake", r"\bsnowflake\b"),
    ("Databricks", r"\bdatabricks\b"),
    ("ETL/ELT", r"\betl\b|\belt\b"),
    ("Data pipelines", r"data pipelines?"),
    ("Data warehousing", r"data warehous(e|ing)"),
    ("Redshift", r"\bredshift\b"),
    ("BigQuery", r"\bbigquery\b"),
    ("PostgreSQL", r"\b(postgresql|postgres)\b"),
    ("MySQL", r"\bmysql\b"),
    ("MongoDB", r"\bmongo(db)?\b"),
    ("Redis", r"\bredis\b"),
    ("React", r"\breact\b"),
    ("Angular", r"\bangular\b"),
    ("Node.js", r"\bnode(\.js)?\b"),
    ("Django", r"\bdjango\b"),
    ("Flask", r"\bflask\b"),
    ("Spring", r"\bspring( boot)?\b"),
    ("GraphQL", r"\bgraphql\b"),
    ("REST", r"\brest(ful)?\b"),
    ("Microservices", r"microservices?"),
    ("Docker", r"\bdocker\b"),
    ("Kubernetes", r"\bkubernetes\b|\bk8s\b"),
    ("Terraform", r"\bterraform\b"),
    ("CI/CD", r"ci/cd|continuous integration"),
    ("Git", r"\bgit\b|github|gitlab"),
    ("Machine Learning", r"machine learning|\bml\b"),
    ("Deep Learning", r"deep learning"),
    ("TensorFlow", r"\btensorflow\b"),
    ("PyTorch", r"\bpytorch\b"),
    ("scikit-learn", r"scikit-learn|sklearn"),
    ("NLP", r"\bnlp\b|natural language processing"),
    ("LLMs/GenAI", r"\bllm\b|large language model|generative ai|\bgenai\b"),
    ("Pandas", r"\bpandas\b"),
    ("Tableau", r"\btableau\b"),
    ("Power BI", r"power bi"),
    ("Looker", r"\blooker\b"),
    ("Agile/Scrum", r"\bagile\b|\bscrum\b"),
    ("System Design", r"system design|distributed systems"),
    ("Data Structures & Algorithms", r"data structures|algorithms"),
    ("Unit Testing", r"unit test|test-driven|\btdd\b"),
)
