"""All queries over the driver's tables, each with its SQL where SQL can express it."""

from agoraflow.plans import relational, rules, site

QUERIES = {**relational.Q, **rules.Q, **site.Q}
SQL = {**relational.SQL, **rules.SQL, **site.SQL}
FLAGSHIP = "feed_page"
