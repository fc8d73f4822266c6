"""Route files: nesting, statements that go over lines, every construct, and links to instance methods."""

from loomgraph.operators import overlays, rails

ROUTES = '''# routes
Rails.application.routes.draw do
  get "/a", to: "users#index"   # "comment"
  post '/b', to: 'admin/users#create', as: :make
  put("/c",
      to: "things#update",
      as: "c")
  resources :users, only: [:show] do
    get "/hidden", to: "a#b"
    member do
      get "/deep", to: "a#b"
    end
  end
=begin
  get "/no", to: "a#b"
=end
  namespace(:admin) { get "/x", to: "a#b" }
  if Rails.env.test?
    get "/t", to: "a#b"
  else
    get "/u", to: "a#b"
  end
  get "/m", to: "a#b" unless x
  root to: "home#index"
  get "/r" => "a#b"
  get "/e", "/f", to: "a#b"
  get path, to: "a#b"
  get "/#{id}", to: "a#b"
  get "/q\\\\n", to: "a#b"
  get "", to: "a#b"
  get "/o", to: "a#b", via: :all
  get "/as", to: "a#b", as: name
  get "/none"
  get "/t", to: redirect("/x")
  get "/bad", to: "Users#index"
  get "/#not-a-comment", to: "a#b"
  get "/blk", to: "a#b" do
  end
  helper = 1
  devise_for :users
end
get "/outside", to: "a#b"
__END__
Rails.application.routes.draw do
  get "/late", to: "a#b"
end
'''


def test_declarations_of_a_route_file(spark):
    files = [("r.rb", ROUTES), ("odd.rb", "Other.draw do\n  get '/x', to: 'a#b'\nend\nclass A\n  def draw\n  end\nend\nMy::App::Application.routes.draw do\n  get '/y', to: 'a#b'\nend\n"), ("e.rb", ""), ("n.rb", None)]
    got = rails.route_declarations(spark.createDataFrame(files, "path string, text string").repartition(2)).collect()
    rows = [(r.verb, r.route, r.target, r.construct) for r in sorted(got, key=lambda r: r.line) if r.path == "r.rb"]
    odd = lambda c: (None, None, None, c)
    assert rows == [
        ("get", "/a", "users#index", None), ("post", "/b", "admin/users#create", None), ("put", "/c", "things#update", None), odd("resources"), odd("namespace"), odd("conditional"), odd("conditional"), odd("root"),
        odd("hash_rocket_target"), odd("extra_arguments"), odd("non_literal_path"), odd("interpolated_literal"), odd("malformed_literal"), odd("malformed_literal"), odd("unsupported_option"), odd("unsupported_option"),
        odd("missing_target"), odd("non_literal_target"), odd("malformed_target"), ("get", "/#not-a-comment", "a#b", None), odd("route_block"), odd("other_statement"), odd("devise_for"),
    ]
    assert sorted((r.line, r.verb, r.construct) for r in got if r.path == "odd.rb") == [(1, None, "unrecognized_draw_receiver"), (9, "get", None)]
    assert {r.path for r in got} == {"r.rb", "odd.rb"}


def test_depth_is_a_running_sum(spark):
    text = "a do\n  b { |x|\n    c\n  }\n  if d then e end\n  while f do\n    g\n  end\nend\nh\n"
    got = rails.statements(spark.createDataFrame([("p", text)], "path string, text string")).collect()
    assert [(r.code.split()[0], r.depth) for r in sorted(got, key=lambda r: r.line)] == [("a", 0), ("b", 1), ("c", 2), ("}", 2), ("if", 1), ("while", 1), ("g", 2), ("end", 2), ("end", 1), ("h", 0)]


def test_routes_link_to_instance_methods_of_the_same_files(spark):
    declared = rails.route_targets(rails.route_declarations(spark.createDataFrame([("r.rb", "Rails.application.routes.draw do\nget '/a', to: 'users#index'\nget '/b', to: 'users#make'\nget '/c', to: 'users#far'\nget '/d', to: 'gone#x'\nend\n")], "path string, text string")))
    methods = spark.createDataFrame([("UsersController", "index", "u.rb", "instance"), ("UsersController", "make", "u.rb", "class"), ("UsersController", "far", "other.rb", "instance"), ("GoneController", "x", "g.rb", "instance")], "owner string, name string, path string, category string")
    classes = spark.createDataFrame([("UsersController", "u.rb")], "owner string, path string")
    got = {r.route_id: (r.outcome, r.path) for r in overlays.routes(declared, methods, classes).collect()}
    assert got == {"r.rb:2": ("INFERRED", "u.rb"), "r.rb:3": ("ACTION_NOT_FOUND", None), "r.rb:4": ("ACTION_NOT_FOUND", None), "r.rb:5": ("CONTROLLER_NOT_FOUND", None)}
