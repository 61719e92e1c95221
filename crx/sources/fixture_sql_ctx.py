"""DuckDB twins of the context fixtures."""

from crx.sources.fixture_sql import register

register("context_reviews", """
  SELECT conv_id AS review_id,
         CAST(CASE conv_id % 4 WHEN 0 THEN 4000 WHEN 1 THEN 1000 WHEN 2 THEN 333 END AS BIGINT) AS token_budget,
         'Conversation ' || conv_id::VARCHAR AS title, 'Turns of conversation ' || conv_id::VARCHAR AS description,
         CASE conv_id % 3 WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN ['src/f1.py', 'docs/readme.md'] END AS changed_files
  FROM conversations GROUP BY conv_id""")

register("context_budgets", """
  SELECT *, CAST(trunc(coalesce(token_budget, 4000)::DOUBLE * 0.4::DOUBLE) AS BIGINT) AS diff_budget,
         CAST(trunc(coalesce(token_budget, 4000)::DOUBLE * 0.2::DOUBLE) AS BIGINT) AS ast_budget,
         CAST(trunc(coalesce(token_budget, 4000)::DOUBLE * 0.2::DOUBLE) AS BIGINT) AS files_budget,
         CAST(trunc(coalesce(token_budget, 4000)::DOUBLE * 0.1::DOUBLE) AS BIGINT) AS project_budget
  FROM context_reviews""")

register("context_files", """
  SELECT conv_id AS review_id, turn AS file_seq, 'doc/' || role || '_' || turn::VARCHAR || '.md' AS path,
         CASE WHEN turn % 5 <> 3 THEN text END AS content
  FROM conversations""")

register("packed_exp", """
  SELECT review_id, file_seq, path, t, files_budget - prior AS remaining, content
  FROM (SELECT f.*, b.files_budget, greatest(1, length(f.content) // 4) AS t,
               coalesce(sum(greatest(1, length(f.content) // 4)) OVER (PARTITION BY f.review_id ORDER BY f.file_seq
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
        FROM context_files f JOIN context_budgets b ON b.review_id = f.review_id
        WHERE f.content IS NOT NULL) x
  WHERE files_budget - prior > 0""")

register("repo_files", """
  SELECT p_partkey % 25 AS repository_id, p_partkey AS file_id,
         CASE WHEN p_size % 8 > 0 THEN array_to_string(list_transform(range(0, p_size % 8), lambda i: 'lvl' || i::VARCHAR), '/') || '/' ELSE '' END
           || ['requirements.txt','Pipfile','setup.cfg','pyproject.toml','pom.xml','package.json','go.sum','Cargo.lock',
               'Makefile','main.py','README.md','App.java','.github/workflows/ci.yml','docs','requirements-dev.txt',
               'package-lock.json'][(p_partkey % 16)::INT + 1] AS path,
         p_partkey % 16 = 13 AS is_dir, '# ' || p_name AS content
  FROM part""")
