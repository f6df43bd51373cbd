"""A corpus of source files derived from a table of documents.

The text tables hold prose, not code.  Each document becomes one source file: its
whole text is placed, as comment lines, inside one of the snippets below.  Natural
language supplies the volume (and words that look like loops), the snippets supply
code of every supported kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKER = "<<BODY>>"


@dataclass(frozen=True)
class Snippet:
    ext: str
    comment: str
    body: str


SNIPPETS: tuple[Snippet, ...] = (
    Snippet(".py", "# ", '''import json
import requests
from store import dynamodb, table
<<BODY>>
def load_users(ids):
    rows = []
    for user_id in ids:
        item = dynamodb.get_item(Key={"id": user_id})
        extra = requests.get(f"https://api.example.com/{user_id}")
        rows.append(json.dumps({"item": item, "extra": extra.json()}))
    return rows


print(len(load_users([1, 2])))
'''),
    Snippet(".py", "# ", '''import pickle


class Report:
    def handle_request(self, cursor, session, items):
        cursor.execute("SELECT * FROM orders")
        cursor.execute("SELECT * FROM orders LIMIT 10")
        cursor.execute("SELECT first_name FROM people")
        session.execute("DELETE FROM carts")
        while items:
            blob = pickle.dumps(items.pop())
            self.db.query("select " + blob)
            self.db.query(f"SELECT name FROM t WHERE id = {blob}")
<<BODY>>
        def inner():
            return self.table.scan("everything")
        return inner()
'''),
    Snippet(".py", "# ", '''async def collect(db, redis, ids):
    found = [db.get(i) for i in ids]
    keys = {redis.hget("h", k): db.find({"k": k}) for k in found}
    names = {n.strip() for n in keys}
    total = sum(len(x) for x in all(names))
    async for row in db.query("select everything"):
        print(row)
    for row in db.collection("users").find({}):
        client().post(row)
        conn["main"].execute("select a")
        row.save(e(), a.b.fetchone())
    else:
        sqs.send_message(QueueUrl="q")
<<BODY>>
    while True:
        try:
            yaml.load(open("f"))
        finally:
            break
'''),
    Snippet(".py", "# ", '''def broken(:
    for x in y:
        requests.get(x)
<<BODY>>
'''),
    Snippet(".pyw", "# ", '''import httpx
\f
def view_page(session, urls):
    page = [session.get(u, timeout=1) for u in urls]
    rows = session.query("SELECT * FROM Wide")
    for u in urls:
        lambda_client.invoke(u)
        u.Session.GET("/a")
<<BODY>>
    return [dump(r) for r in rows] or session.execute(f"select {rows}")
'''),
    Snippet(".js", "// ", '''const axios = require("axios");
<<BODY>>
async function loadUsers(ids) {
  const out = [];
  for (const id of ids) {
    const res = await fetch(`/users/${id}`);
    const body = JSON.parse(await res.text());
    out.push(body);
  }
  return out;
}
module.exports = { loadUsers };
'''),
    Snippet(".ts", "// ", '''export async function syncAll(items: Item[], db: Db) {
  items.forEach(async (item) => {
    const doc = await db.collection("users").findOne({ id: item.id });
    await redis.get(item.id); await axios.get(item.url);
    new Promise((resolve) => setTimeout(resolve, 10));
  });
<<BODY>>
  const ids = items.map((i) => i.id)
  const found = await Model.find({ ids });
  $.ajax({ url: "/x" });
  superagent.get("/y");
}
'''),
    Snippet(".mjs", "// ", '''import got from "got";
<<BODY>>
export function drain(queue, dynamodb) {
  while (queue.length) {
    for (const q of queue) {
      query(q); q.execute(); JSON.stringify(q);
    }
    dynamodb.put(queue); q.getItem(1);
  }
  do {
    http.post("/z");
  } while (queue.pop());
  if (queue) { request("/r"); }{ got("/g"); }
  got("/h")
}
'''),
    Snippet(".jsx", "// ", '''export function View(props) {
  const data = JSON.parse(props.raw);
  fetch("/once");
<<BODY>>
  return data;
}
'''),
    Snippet(".java", "// ", '''@RestController
public class Orders {
    public List<Order> handleAll(List<Long> ids) {
        List<Order> out = new ArrayList<>();
        for (Long id : ids) {
            Order o = orderRepository.findById(id).orElse(null);
            String s = restTemplate.getForObject("/p/" + id, String.class);
            out.add(objectMapper.readValue(s, Order.class));
        }
        session.load(Order.class, 1L);
        return out;
    }
<<BODY>>
    public Order once(Long id) {
        return orderRepository.findById(id).orElse(null);
    }
}
'''),
    Snippet(".java", "// ", '''public class Nested {
    void walk(List<Row> rows) throws Exception {
        rows.stream().map(r -> r.id()).forEach(id -> {
            userDao.get(id);
        });
        do {
            if (rows.isEmpty()) { break; }{ webClient.post(); }
            statement.executeQuery("select 1");
        } while (next());
<<BODY>>
        }
        mapper.writeValueAsString(rows);
    }
    void after() { entityManager.find(Row.class, 1); }
}
'''),
    Snippet(".java", "// ", '''@Service
public class Batch {
    @Scheduled
    public void processQueue(List<Msg> queue) {
<<BODY>>
        while (!queue.isEmpty()) {
            jdbcTemplate.update("x"); dynamoDb.getItem(r);
            s3Client.putObject(b, k, f);
            while (resultSet.next()) { lambdaClient.invoke(req); new Gson().toJson(req); }
            URL u = open(); u.openConnection();
        }
    }
}
'''),
    Snippet(".java", "// ", '''public class Plain {
    public Order once(Long id) {
        String s = restTemplate.getForObject("/p/" + id, String.class);
<<BODY>>
        return orderRepository.findById(id).orElse(null);
    }
}
'''),
    Snippet(".txt", "// ", '''const list = require("list");
<<BODY>>
list.filter((x) => x.ok).map(async (x) => {
  await fetch(x.url);
});
export default list;
'''),
    Snippet(".md", "> ", '''Notes
<<BODY>>
'''),
    Snippet(".cjs", "// ", '''let total = 0;\r
for (let i = 0; i < 10; i++) {\r
  axios({ url: "/a" }); Model.aggregate([]);\r
<<BODY>>\r
}\r
\r
var tail = Model.updateMany({});\r
'''),
)

# Calls of the Python snippets, labelled by hand: snippet, seq, line in the snippet,
# object, method, in loop, in hot function, query literal.
PYTHON_LABELS: tuple[tuple, ...] = (
    (0, 1, 8, "dynamodb", "get_item", True, False, None),
    (0, 2, 9, "requests", "get", True, False, "https://api.example.com/"),
    (0, 3, 10, "rows", "append", True, False, None),
    (0, 4, 10, "json", "dumps", True, False, None),
    (0, 5, 10, "extra", "json", True, False, None),
    (0, 6, 14, "", "print", False, False, None),
    (0, 7, 14, "", "len", False, False, None),
    (0, 8, 14, "", "load_users", False, False, None),
    (1, 1, 6, "cursor", "execute", False, True, "select * from orders"),
    (1, 2, 7, "cursor", "execute", False, True, "select * from orders limit 10"),
    (1, 3, 8, "cursor", "execute", False, True, "select first_name from people"),
    (1, 4, 9, "session", "execute", False, True, "delete from carts"),
    (1, 5, 11, "pickle", "dumps", True, True, None),
    (1, 6, 11, "items", "pop", True, True, None),
    (1, 7, 12, "db", "query", True, True, None),
    (1, 8, 13, "db", "query", True, True, "select name from t where id = "),
    (1, 9, 16, "table", "scan", False, False, "everything"),
    (1, 10, 17, "", "inner", False, True, None),
    (2, 1, 2, "db", "get", True, False, None),
    (2, 2, 3, "redis", "hget", True, False, "h"),
    (2, 3, 3, "db", "find", True, False, None),
    (2, 4, 4, "n", "strip", True, False, None),
    (2, 5, 5, "", "sum", False, False, None),
    (2, 6, 5, "", "len", True, False, None),
    (2, 7, 5, "", "all", True, False, None),
    (2, 8, 6, "db", "query", False, False, "select everything"),
    (2, 9, 7, "", "print", False, False, None),
    (2, 10, 8, "collection", "find", True, False, None),
    (2, 11, 8, "db", "collection", True, False, "users"),
    (2, 12, 9, "", "client", True, False, None),
    (2, 13, 11, "row", "save", True, False, None),
    (2, 14, 11, "", "e", True, False, None),
    (2, 15, 11, "b", "fetchone", True, False, None),
    (2, 16, 13, "sqs", "send_message", True, False, None),
    (2, 17, 17, "yaml", "load", True, False, None),
    (2, 18, 17, "", "open", True, False, "f"),
    (4, 1, 4, "session", "get", True, True, None),
    (4, 2, 5, "session", "query", False, True, "select * from wide"),
    (4, 3, 7, "lambda_client", "invoke", True, True, None),
    (4, 4, 8, "session", "get", True, True, "/a"),
    (4, 5, 10, "", "dump", True, True, None),
    (4, 6, 10, "session", "execute", False, True, "select "),
)


def source_files(documents: DataFrame, snippet_by: Column | None = None) -> DataFrame:
    """Table ``files(file_id, path, code, declared_language)`` from ``documents``."""
    number = F.col("doc_id") if snippet_by is None else snippet_by
    pick = (number % len(SNIPPETS) + 1).cast("int")

    def choose(values: list[str]):
        return F.element_at(F.array(*(F.lit(v) for v in values)), pick)

    comment = choose([s.comment for s in SNIPPETS])
    body = F.concat(comment, F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), comment)))
    folder = (
        F.when(F.col("doc_id") % 7 == 3, "node_modules/").when(F.col("doc_id") % 11 == 5, ".github/").otherwise("")
    )
    declared = (
        F.when(F.col("doc_id") % 13 == 0, "Python")
        .when(F.col("doc_id") % 13 == 1, "cobol")
        .when(F.col("doc_id") % 13 == 2, "unknown")
    )
    return documents.select(
        F.col("doc_id").alias("file_id"),
        F.concat(
            F.lit("repo/"), "source", F.lit("/"), folder, F.lit("f"),
            F.col("doc_id").cast("string"), choose([s.ext for s in SNIPPETS]),
        ).alias("path"),
        F.replace(choose([s.body for s in SNIPPETS]), F.lit(MARKER), body).alias("code"),
        declared.alias("declared_language"),
    )
