from typeharvest.llm import secrets


def test_long_account_ids_are_whole(frame):
    account = "client." * 12 + "end"
    text = f"account={account} password=abcdefghijklmnop"
    assert len(account) > 64
    row = secrets.scan(frame([(1, text)])).collect()[0]
    assert f"login:0:{len('account=' + account)}" in row.spans
    assert secrets.redact(frame([(1, text)])).collect()[0].text == "account=<secret> password=<secret>"
