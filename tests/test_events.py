"""Webhook parsing and slash commands in the shape of the reference's tests."""

import json

from crx.operators import events as EV


def _d(spark, rows):
    return spark.createDataFrame([(i, t, json.dumps(p)) for i, (t, p) in enumerate(rows)],
                                 "delivery_id long, event_type string, payload string")


def test_event_classes_and_identifiers(spark):
    repo = {"name": "r", "owner": {"login": "o"}}
    rows = [("ping", {"zen": "z"}),
            ("pull_request", {"action": "opened", "pull_request": {"number": 5}, "repository": repo, "sender": {"login": "u"}}),
            ("pull_request", {"action": "reopened", "pull_request": {"number": 0}, "number": 7, "repository": repo}),
            ("pull_request", {"action": "synchronize", "number": 9, "repository": repo}),
            ("pull_request", {"action": "closed", "pull_request": {"number": 3}, "repository": repo}),
            ("issue_comment", {"action": "deleted", "issue": {"pull_request": {"url": "https://x/pulls/42/"}},
                               "comment": {"body": "/review"}, "repository": repo}),
            ("issue_comment", {"action": "created", "issue": {}, "comment": {"body": "hi"}, "repository": repo}),
            ("issue_comment", {"action": "created", "issue": {"pull_request": {"url": "https://x/pulls/abc"}},
                               "repository": repo}),
            ("installation", {"action": "created", "installation": {"id": 77}}),
            ("installation_repositories", {"action": "added"})]
    ev = EV.event_identifiers(EV.parse_events(_d(spark, rows))).orderBy("delivery_id").collect()
    assert [r.event_class for r in ev] == ["unknown", "pr_open", "pr_open", "pr_sync", "unknown", "comment",
                                           "comment", "comment", "installation", "installation"]
    assert [r.pr_number for r in ev] == [0, 5, 7, 9, 0, 42, 0, 0, 0, 0]
    assert (ev[1].owner, ev[1].repo, ev[1].sender) == ("o", "r", "u")
    assert (ev[4].owner, ev[4].repo) == ("", "")
    assert [r.installation_id for r in ev][-2:] == [77, 0]


def test_review_commands(spark):
    bodies = ["/review", "/review focus:security", "/review focus:security,logic", "/REVIEW",
              "  /review  ", "/review focus:bogus", "/Review focus:Security", "please /review",
              "/review focus:", "/reviewer", "/review focus:style,bogus"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, comment_body string")
    got = [(r.is_command, r.categories) for r in EV.parse_commands(df).orderBy("i").collect()]
    assert got == [(True, None), (True, ["security"]), (True, ["security", "logic"]), (True, None),
                   (True, None), (True, None), (True, None), (False, None),
                   (False, None), (False, None), (True, ["style"])]


def test_authorize_without_and_with_collaborators(spark):
    cmds = spark.createDataFrame([("o", "r", "alice"), ("o", "r", "bob")], "owner string, repo string, sender string")
    assert all(r.allowed for r in EV.authorize_commands(cmds).collect())
    col = spark.createDataFrame([("o", "r", "alice")], "owner string, repo string, login string")
    got = {r.sender: r.allowed for r in EV.authorize_commands(cmds, col).collect()}
    assert got == {"alice": True, "bob": False}
